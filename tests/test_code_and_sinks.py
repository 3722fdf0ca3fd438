import datetime

import pytest
from pyspark.sql import functions as F

from changelens import sinks
from changelens.operators import code_context, service, tokens

D = datetime.date
AGENT = '''"""Doc about m-1."""
MODEL = "m-1"  # m-1 here
TABLE = ["m-1", "m-2"]
def call(client):
    """m-1 again"""
    client.run(model="m-1")
    return client.run(MODEL, PRICES["m-1"])
'''
USER = "from src.agent import MODEL as M\n\ndef f():\n    return M\n"
JS = '// m-1\nconst a = `m-1`; /* m-1\n m-1 */ run("m-1")\n'


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("src/agent.py", ".py", AGENT), ("src/user.py", ".py", USER), ("a.js", ".js", JS), ("broken.py", ".py", "def ("), ("null.py", ".py", None)], "path string, suffix string, text string")
    records = spark.createDataFrame([("r", ["m-1"], "rest")], "id string, signatures array<string>, kind string")
    from changelens.functions.text import lines

    rows = lines(files, "text", ["path"]).select(F.col("path").alias("file"), F.col("line_no").alias("n"), "line")
    hits = tokens.token_hits(rows, tokens.signature_table(records), ["file", "n"]).drop("line").withColumnRenamed("n", "line")
    return files, hits


def test_tiers(found):
    files, hits = found
    got = {(r.file, r.line, r.tier) for r in code_context.tiers(hits, files).collect()}
    assert got == {("src/agent.py", 2, "use"), ("src/agent.py", 3, "listed"), ("src/agent.py", 6, "use"), ("src/agent.py", 7, "use"), ("a.js", 2, "use"), ("a.js", 3, "use")}


def test_constants_are_followed(found):
    files, hits = found
    got = {(r.file, r.line, r.via) for r in code_context.constant_uses(code_context.tiers(hits, files), files).collect()}
    assert got == {("src/user.py", 4, "M (src/agent.py:2)")}  # line 7 of the agent is a direct hit already


def known(spark):
    rows = [("a", "Acme", "model", "breaking", D(2026, 6, 1), ["Nova-1"], "Nova goes", "d", "u"), ("b", "Acme", "model", "deprecation", D(2026, 1, 1), ["nova-1", "nova-2"], "s", "d", "u"), ("c", "Other Co", "rest", "silent", D(2026, 6, 9), ["/v1/x"], "s", "d", "u")]
    return spark.createDataFrame(rows, "id string, vendor string, kind string, severity string, effective date, signatures array<string>, summary string, detail string, source_url string").withColumns({"fix_hint": F.lit("do"), "load_ordinal": F.lit(1)})


def test_service(spark):
    records = known(spark)
    got = {r.asked: (r.records, r.id, r.answer) for r in service.check_models(records, ["NOVA-1", "nova-2-20250101", "/V1/x", "/v1/x"], "2026-05-01").collect()}
    assert got["NOVA-1"] == (2, "a", "NOVA-1 is shut down on Jun 1, 2026") and got["nova-2-20250101"][:2] == (1, "b")
    assert got["/V1/x"][0] == 0 and got["/v1/x"][1] == "c"
    assert [r.id for r in service.list_upcoming(records, "2026-06-01", 7).collect()] == ["a"]
    assert [r.id for r in service.list_upcoming(records, "2026-06-01", 90, "other-co").collect()] == ["c"]
    assert [r.vendor for r in service.vendors_instead(records, "nobody").collect()] == ["Acme", "Other Co"] and service.vendors_instead(records, "acme").count() == 0
    assert [r.id for r in service.search_changes(records, "NOVA").collect()] == ["a", "b"]
    for wrong in (lambda: service.list_upcoming(records, "2026-01-01", 0), lambda: service.search_changes(records, " "), lambda: service.check_models(records, [], "2026-01-01")):
        with pytest.raises(ValueError):
            wrong()


def test_tables_outlive_runs(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert sinks.read_table(spark, path) is None
    assert sinks.insert_absent(rows(("a", 1), ("a", 1)), path, ["k"]).count() == 1
    assert [r.k for r in sinks.insert_absent(rows(("a", 9), ("b", 2)), path, ["k"]).collect()] == ["b"]
    sinks.upsert(rows(("a", 5)), path, ["k"])
    assert sorted((r.k, r.v) for r in sinks.read_table(spark, path).collect()) == [("a", 5), ("b", 2)]


def test_exports(spark, tmp_path):
    records = known(spark)
    assert "&amp;" in sinks.sitemap(spark.createDataFrame([("https://x/?a&b", D(2026, 1, 2))], "loc string, lastmod date")).head().element
    assert sinks.atom(records, "https://x").where("id = 'a'").head().element.count("https://x/a.html") == 2
    sinks.by_vendor(records, f"{tmp_path}/v")
    assert spark.read.json(f"{tmp_path}/v").count() == 3
    sites = spark.createDataFrame([("a", "f.py", 3, 1, "x | y")], "record_id string, file string, line int, place int, snippet string")
    assert "f.py:3" in sinks.brief(records, sites).head().brief
    counts = records.select(F.col("id").alias("record_id"), "summary", "severity", "effective", F.lit(1).alias("in_code"), F.lit(0).alias("listed"), F.lit(0).alias("in_test"))
    blocks = {r.record_id: r.block for r in sinks.markdown(counts, sites).collect()}
    assert blocks["a"].endswith("- `f.py:3` x \\| y") and "Jun 1, 2026: 1 in code" in blocks["a"]
    assert sinks.gate(records, F.col("severity") == "breaking") == 1 and sinks.gate(records, F.lit(False)) == 0


def test_a_crash_before_the_new_name_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first, second = spark.range(3), spark.range(5)
    sinks.write_table(first, path)
    held = sinks._fs

    def fails(session, place):
        if place.endswith("/current"):
            raise OSError("crashed")
        return held(session, place)

    with monkeypatch.context() as m:
        m.setattr(sinks, "_fs", fails)
        with pytest.raises(OSError):
            sinks.write_table(second, path)
    assert sinks.read_table(spark, path).count() == 3
    sinks.write_table(second, path)
    assert sinks.read_table(spark, path).count() == 5 and not [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(".current") and not p.name.endswith(".crc")]

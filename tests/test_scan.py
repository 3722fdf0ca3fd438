"""Sites: named variants, partners' forms, prose in data, excluded calls, constants of scripts."""

import re

import pytest
from pyspark.sql import functions as F

from changelens.functions.text import token_pattern
from changelens.operators import code_context, extract, feed, scan, tokens
from changelens.plans import base


def test_names_of_a_record(spark):
    text = "Nova-4 goes, nova-4.5-max too, plus -Mini variants (not nova-4(-pro)); -x"
    assert spark.range(1).select(scan.record_names(F.lit(text))).head()[0] == ["-mini", "-x", "nova-4", "nova-4.5-max"]


@pytest.mark.parametrize(
    ("line", "named", "hit"),
    [
        ("nova-4-mini", ("-mini",), True), ("nova-4-Mini", ("-mini",), True), ("nova-4-mini-x", ("-mini",), True), ("nova-4-minim", ("-mini",), False), ("nova-4-max", ("nova-4-max",), True),
        ("nova-4-max-x", ("nova-4-max",), False), ("nova-4-MAX", ("nova-4-max",), True), ("nova-4-0613-mini", ("-mini",), True), ("nova-4-0613-pro", ("-mini",), False), ("nova-4-0613-Pro", (), False), ("nova-4-0613.", (), False), ("nova-4-max", ("-mini",), False),
    ],
)
def test_named_variants(spark, line, named, hit):
    assert bool(tokens.token_positions(line, "nova-4", re.compile(tokens.python_pattern("nova-4", True, named)))) == hit
    assert spark.createDataFrame([(line,)], "line string").select(F.col("line").rlike(token_pattern("nova-4", True, named))).head()[0] == hit


def test_named_signatures(spark):
    records = spark.createDataFrame([("a", ["nova-4"], "model", "the -mini one", None, ""), ("b", ["nova-4"], "rest", "the -mini one", "", "")], "id string, signatures array<string>, kind string, summary string, detail string, surface string")
    lines = spark.createDataFrame([(1, "nova-4-mini"), (2, "nova-4-pro"), (3, None)], "n int, line string")
    got = tokens.token_hits(lines, scan.named_signatures(records), ["n"], F.col("named")).select("record_id", "n").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 1), ("b", 2)]


def test_partner_forms(spark):
    lines = ["anthropic.nova-4-20250219-v1:0", "nova-4@20250219", "nova-4@1 and nova-4", "nova-4", "nova-4-20250219"]
    rows = [("a", v, i, line, m.start(), m.end(), True) for v in ("Anthropic", "Other") for i, line in enumerate(lines) for m in re.finditer("nova-4", line)]
    hits = spark.createDataFrame(rows, "record_id string, vendor string, n int, line string, start int, stop int, model boolean")
    kept = scan.not_partner(hits, ["record_id", "vendor", "n"])
    assert sorted({(r.vendor, r.n) for r in kept.collect()}) == [("Anthropic", 2), ("Anthropic", 3), ("Anthropic", 4)] + [("Other", i) for i in range(5)]
    assert kept.where("vendor = 'Anthropic' and n = 2").count() == 2


PROSE = [
    ('{"model": "nova-4"}', ".json", False), ('"description": "The older nova-4 model is going away at the end of the year for all"', ".json", True), ("run: tool --model nova-4 for the whole of the test suite in every one of the jobs", ".yaml", False),
    ("- nova-4 is what we use for the whole of the test suite in all jobs", ".yaml", False), ("model: nova-4 # the one that we have used for the whole of the last year", ".yaml", False),
    ("summary: nova-4 is retired and all callers have to move on by the end of the year", ".yaml", True), ("models: [nova-4, other-2]", ".toml", False), ("note: 'we don''t use the nova-4 model any more since it was retired last year'", ".yaml", True),
    ("The older models of the family, nova-4 included, are retired at the end of the year", ".yaml", True), ("nova-4 short text", ".yaml", False),
]


def test_prose_in_data(spark):
    rows = spark.createDataFrame([(i, line, line.index("nova-4"), line.index("nova-4") + 6, suffix) for i, (line, suffix, _) in enumerate(PROSE)], "i int, line string, start int, stop int, suffix string")
    got = {r.i: r.p for r in rows.select("i", scan.prose(F.col("line"), F.col("start"), F.col("stop"), F.col("suffix")).alias("p")).collect()}
    assert [got[i] for i in range(len(PROSE))] == [talk for *_, talk in PROSE]


def test_only_models_in_data_are_asked_for_prose(spark):
    line = PROSE[1][0]
    rows = [(suffix, model, line, line.index("nova-4"), line.index("nova-4") + 6) for suffix in (".json", ".py", None) for model in (True, False)]
    hits = spark.createDataFrame(rows, "suffix string, model boolean, line string, start int, stop int")
    assert scan.not_prose(hits).count() == 5


def test_excluded_calls(spark):
    text = ["x.list({", "  status: 1 })", "x.list({ status: 2 })", "x.list({ other: 1 })", "x.list", "({ status: 1 })", "y = [x.list(", "", "", "", "", "", "{ status: 1 })]"]
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate(text, 1)], "file string, line_no int, line string")
    hits = lines.where(F.col("line").contains("x.list")).select("file", "line_no", "line", (F.instr("line", "x.list") - 1).alias("start"), F.lit("x.list").alias("signature"), F.array(F.lit("x.list({ status:"), F.lit("z")).alias("excludes"))
    assert sorted(r.line_no for r in scan.not_called(hits, lines).collect()) == [4, 5, 7]
    assert scan.not_called(hits.withColumn("excludes", F.lit(None).cast("array<string>")), lines).count() == 5


def test_excluded_calls_over_blocks_without_a_join(spark, monkeypatch):
    text = ["x.list({", "", "", "", "", "status: 1 })", "x.list({", "", "", "", "", "", "status: 1 })", "x.list( x.list({ status: 2 }))"]
    lines = spark.createDataFrame([(f, i, line) for f in ("f", "g") for i, line in enumerate(text, 1)] + [(None, 1, "x.list({")], "file string, line_no int, line string")
    rows = [(f, i, m.start(), "x.list", id_) for f in ("f", "g", None) for i, line in enumerate(text, 1) for m in re.finditer("x.list", line) for id_ in ("a", "b")] + [("h", 1, 0, "x.list", "a")]
    hits = spark.createDataFrame(rows, "file string, line_no int, start int, signature string, record_id string").withColumn("excludes", F.array(F.lit("x.list({ status:")))
    want = sorted((f, i, at, id_) for f in ("f", "g") for i, at in ((7, 0), (14, 0)) for id_ in ("a", "b"))
    for block in (6, 7, 10_000):  # a call ends in the next block at the latest
        monkeypatch.setattr(scan, "CALL_BLOCK", block)
        assert sorted((r.file, r.line_no, r.start, r.record_id) for r in scan.not_called(hits, lines, partitions=3).collect()) == want, block
    assert "Join" not in scan.not_called(hits, lines)._jdf.queryExecution().executedPlan().toString()


def test_more_rows_are_dealt_out_to_more_parts(spark):
    rows = spark.range(10)
    few = base.parts(rows, 10)
    assert base.spread(rows, "id").rdd.getNumPartitions() == few
    assert base.parts(rows, 100 * few * base.SPREAD_ROWS) == 100 * few == base.spread(rows, "id", rows=100 * few * base.SPREAD_ROWS).rdd.getNumPartitions()


SCRIPTS = {
    "src/ids.ts": "export const MODEL: string = 'nova-4';\nconst other = \"nova-4\";\nfunction f() {\n  const inner = `nova-4`; // {\n  if (a) { call(inner) }\n  return { inner: 1, b: c ? inner : 2 };\n}\ncall(inner);\n",
    "src/use.js": "import { MODEL as M, x } from './ids';\n// M\ncall(M);\nconst o = { M: 1 };\no.M = 2;\nswitch (v) {\n  case M: call(1)\n}\n",
    "lib/index.mjs": "export let ID = 'nova-4'\n",
    "app.tsx": "import { ID } from './lib';\nimport { MODEL } from 'src/ids';\nfoo(ID, MODEL)\n",
    "src/ids.py": "MODEL = 'nova-4'\n",
}


def test_constants_of_scripts(spark):
    files = spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], t) for p, t in SCRIPTS.items()], "path string, suffix string, text string")
    hits = [("r", "nova-4", p, i, line.index("nova-4"), 0) for p, t in SCRIPTS.items() for i, line in enumerate(t.split("\n"), 1) if "nova-4" in line]
    direct = spark.createDataFrame(hits, "record_id string, signature string, file string, line int, start int, stop int")
    got = scan.sites(direct, files).collect()
    assert sorted((r.file, r.line, r.via) for r in got if r.via) == [
        ("app.tsx", 3, "ID (lib/index.mjs:1)"), ("src/ids.ts", 5, "inner (src/ids.ts:4)"), ("src/ids.ts", 6, "inner (src/ids.ts:4)"), ("src/use.js", 3, "M (src/ids.ts:1)"), ("src/use.js", 7, "M (src/ids.ts:1)"),
    ]
    assert sum(not r.via for r in got) == len(hits)
    assert code_context.script_names("a.js", "") == [] and scan.sites(direct.limit(0), files).count() == 0


def test_drift_files_and_ignore_lines(spark):
    events = spark.createDataFrame([("tool:a_b.input.x",), ("$.data[].eta",), ("$",), ("$.items[]",)], "path string")
    assert [r.signature for r in scan.drift_signatures(events).collect()] == ["a_b", "eta", "items"]
    rows = spark.createDataFrame([("a\\b.py",), ("a/c.py",), (None,)], "file string")
    assert [r.file for r in scan.only_files(rows, spark.createDataFrame([("/a/b.py",), ("/a/b.py",)], "path string")).collect()] == ["a\\b.py"]
    assert scan.ignore_patterns(" a/ \n# c\n\n*.snap") == ["a/", "*.snap"] and scan.ignore_patterns(None) == []


def test_pages_of_identifiers(spark):
    kind = "id string, vendor string, kind string, severity string, effective date, signatures array<string>, context array<array<string>>, files array<string>, repo_context array<array<string>>"
    from datetime import date

    rows = [("a", "v", "model", "breaking", date(2026, 1, 1), ["Nova-4", "x={y", "abc", "1234", "nova_4"], [], None, []), ("b", "W", "model", "info", date(2027, 1, 1), ["nova-4"], None, [], None), ("c", "v", "rest", "info", date(2027, 1, 1), ["nova-5"], None, None, None), ("d", "v", "model", "info", date(2027, 1, 1), ["nova-6"], None, ["*.py"], None)]
    got = [tuple(r)[:4] for r in feed.identifiers_by_vendor(spark.createDataFrame(rows, kind), "2026-06-01").collect()]
    assert got == [("v", "nova_4", "nova_4", "a"), ("W", "nova-4", "nova-4", "b")]


def test_changelog_layouts():
    page = "Sep 23, 2026\nx\n\n## Deprecating it\nProse [a](https://x/a), [learn more](https://x/b)\n" + "\n" * 40 + "# 4 March 2026\nBeside.\n- one\n  and on\n- two [z](https://x/z)\n## Sub\n- one\n"
    got = [(e["title"], e["date_text"], e["url"]) for e in extract._entries(page)]
    assert got == [("Deprecating it", "2026-09-23", "https://x/b"), ("Beside.", "2026-03-04", "https://x/z"), ("one and on", "2026-03-04", ""), ("two z", "2026-03-04", "https://x/z"), ("Sub", "2026-03-04", "")]
    far = "Sep 23, 2026\n" + "\n" * 31 + "## Title\ntext\n"
    assert [e["date_text"] for e in extract._entries(far)] == [""]
    rows = "# 2026-01-02\n| a | b |\n|--|--|\n| [t](https://x/t) | why |\n"
    assert [(e["title"], e["text"], e["url"]) for e in extract._entries(rows)] == [("t", "t why", "https://x/t")]


def test_uncovered_retirements_by_the_token_rule(spark):
    from datetime import date

    day = date(2026, 3, 1)
    gone = spark.createDataFrame([("v", "nova-4-0613", [], day), ("v", "nova-4o", [], day), ("v", "ft-x-1", None, day), ("v", "other", ["nova-4"], day), ("w", "nova-4", [], day), ("v", "nova-4.5", [], date(2026, 1, 1))], "vendor string, model string, aliases array<string>, shutdown date")
    records = spark.createDataFrame([("v", day, ["nova-4", "ft:x-1", ""]), ("v", date(2026, 1, 1), ["nova-4"])], "vendor string, effective date, signatures array<string>")
    assert sorted((r.vendor, r.model) for r in extract.uncovered(gone, records).collect()) == [("v", "nova-4.5"), ("v", "nova-4o"), ("w", "nova-4")]
    assert sorted(r.model for r in extract.uncovered(gone, records, "2026-02-01").collect()) == ["nova-4", "nova-4o"]

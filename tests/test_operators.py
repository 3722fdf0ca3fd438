import datetime
import json

import pytest
from pyspark.sql import functions as F

from changelens.functions import dates, text
from changelens.operators import diff, evidence, extract, feed, history, report
from changelens.sources import code, deps, records

D = datetime.date


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc d\n"), (2, ""), (3, None), (4, "x\n\ny")], "id int, text string")
    got = [(r.id, r.line_no, r.line) for r in text.lines(df, "text", ["id"]).orderBy("id", "line_no").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (4, 1, "x"), (4, 2, ""), (4, 3, "y")]


@pytest.mark.parametrize(("words", "day"), [("June 13, 2025", D(2025, 6, 13)), ("Sept. 3rd 2025", D(2025, 9, 3)), ("3 October 2026", D(2026, 10, 3)), ("on 2025-01-02.", D(2025, 1, 2)), ("Not sooner than 2", None), ("May 40, 2025", None)])
def test_parse_date(spark, words, day):
    assert spark.createDataFrame([(words,)], "t string").select(dates.parse_date(F.col("t"))).head()[0] == day


def test_since_compares_at_the_entrys_precision(spark):
    df = spark.createDataFrame([("2026-09",), ("2026-08",), ("2026-09-14",), ("2026-09-15",), ("",)], "d string")
    assert [r[0] for r in df.select(dates.since(F.col("d"), "2026-09-15")).collect()] == [True, False, False, True, True]


def test_normal_text():
    assert text.normal_text('<p>A <b>b</b>old&nbsp;“Word” – x</p><style>p{}</style> [link](http://x) `c` <img alt="shown">​') == 'a bold "word" - x link c shown'
    assert text.normal_text(None) == ""
    assert text.normal_text("[a " * 20_000 + "<b " * 20_000)


def test_shapes_merge_in_order():
    assert diff.infer([1, "s", 2])["items"]["type"] == "integer|string|integer"
    assert diff.infer([[], [1]])["items"]["items"]["type"] == "unknown|integer"
    assert diff.infer([{"a": 1}, {}])["items"]["fields"]["a"]["optional"]
    assert diff.infer([None, 1])["items"] == {"type": "integer", "nullable": True}
    assert diff.infer(True)["type"] == "boolean" and diff.infer(1.0)["type"] == "number"


def paths(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "body string").select(F.inline(diff.schema_paths(F.col("body"))))


def test_shape_events(spark):
    a = {"data": [{"number": "x", "eta": "y", "v": "1000", "deep": {"a": {"b": 1}}}]}
    b = {"data": [{"ship": {"number": "x"}, "eta": None, "v": 1000.0, "deep": 5}], "next": "c"}
    got = {(r.path, r.change, r.severity) for r in diff.shape_events(paths(spark, a), paths(spark, b)).collect()}
    assert got == {
        ("$.data[].number", "removed", "breaking"), ("$.data[].ship", "added", "additive"), ("$.data[].eta", "type_changed", "silent"),
        ("$.data[].v", "type_changed", "breaking"), ("$.data[].deep", "type_changed", "breaking"), ("$.next", "added", "additive"),
    }
    assert diff.shape_events(paths(spark, a), paths(spark, a)).count() == 0


def tools(spark, *rows):
    return spark.createDataFrame([("s", n, None, d, json.dumps(i), None, None) for n, d, i in rows], "server string, name string, title string, description string, input string, output string, annotations string")


def test_tool_events(spark):
    schema = lambda props, required=(): {"type": "object", "properties": props, "required": list(required)}
    before = tools(spark, ("gone", "x", schema({})), ("same", "x", schema({"a": {"type": "string"}})), ("t.x", "old", schema({"a": {"type": "string", "enum": ["p", "q"]}, "b": {"type": "integer"}, "c": {"$ref": "#/defs/c"}, "e": {"type": "array", "items": {"type": "object", "properties": {"z": {"type": "string"}}}}})))
    after = tools(spark, ("new", "x", schema({})), ("same", "x", schema({"a": {"type": "string"}})), ("t.x", "now", schema({"a": {"type": "string", "enum": ["q", "r"]}, "b": {"type": "string"}, "c": {}, "d": {"type": "string"}, "e": {"type": "array", "items": {"type": "object", "properties": {}}}}, ["d", "c"])))
    got = {(r.path, r.change, r.severity) for r in diff.tool_events(before, after).collect()}
    assert got == {
        ("tool:gone", "removed", "breaking"), ("tool:new", "added", "additive"), ("tool:t.x.description", "description_changed", "info"),
        ("tool:t.x.input.a", "enum_values_removed", "breaking"), ("tool:t.x.input.a", "enum_values_added", "additive"), ("tool:t.x.input.b", "type_changed", "breaking"),
        ("tool:t.x.input.c", "became_required", "breaking"), ("tool:t.x.input.d", "added_required", "breaking"), ("tool:t.x.input.e[].z", "removed", "breaking"),
    }


def test_renames_need_a_single_candidate(spark):
    rows = lambda d: spark.createDataFrame([(t, p) for t, ps in d.items() for p in ps], "tool string, p string")
    before, after = rows({"a": "xyz", "b": "mn", "k": "q"}), rows({"a2": "xyw", "b2": "mn", "b3": "mn", "k": "q"})
    assert [(r.old, r.new) for r in diff.likely_renames(before, after, "tool", "p").collect()] == [("a", "a2")]


def sequence(spark, seen, outcomes=None):
    start = datetime.datetime(2026, 1, 1)
    rows = [("k", start + datetime.timedelta(hours=6 * i), (outcomes or {}).get(i, "ok"), h, 1) for i, h in enumerate(seen)]
    return spark.createDataFrame(rows, "key string, ts timestamp, outcome string, hash string, tools int")


@pytest.mark.parametrize(
    ("seen", "kinds"),
    [
        ("abb", ["first_seen", "change"]),
        ("aba", ["first_seen"]),
        ("ababababa", ["first_seen", "unstable"]),
        ("abbaabbaa", ["first_seen", "change", "change", "change", "unstable", "change"]),
        ("abcc", ["first_seen", "change"]),
    ],
)
def test_histories(spark, seen, kinds):
    rows = history.replay(sequence(spark, seen), "key").collect()
    order = {"change": 0, "unstable": 1}
    assert [r.kind for r in sorted(rows, key=lambda r: (r.confirmed_at, order.get(r.kind, 0)))] == kinds


def test_a_change_is_dated_by_its_first_sighting_and_survives_failures(spark):
    rows = {r.kind: r for r in history.replay(sequence(spark, "abbb", {2: "error"}), "key").collect()}
    change = rows["change"]
    assert (change.date.hour, change.confirmed_at.hour, change.from_hash, change.to_hash) == (6, 18, "a", "b")


def test_streaks(spark):
    df = sequence(spark, "aaaaaa", {1: "error", 2: "error", 3: "auth", 5: "error"})
    assert sorted(r.failures for r in history.streaks(df, "key").collect()) == [1, 1, 2]


def test_flags(spark):
    before = spark.createDataFrame([("s", "t", "Sends mail.")], "server string, name string, text string")
    after = spark.createDataFrame([("s", "t", "Sends  mail. Disregard\nprevious notes.​"), ("s", "n", "plain")], "server string, name string, text string")
    assert {(r.name, r.flag) for r in history.new_flags(before, after).collect()} == {("t", "instruction_like_text"), ("t", "hidden_characters")}


PAGE = r"""# Models
## 2026-01-05: old models
| Shutdown date | Model | Recommended replacement |
|---|---|---|
| June 13, 2026 | `m-1` or `m-1-x` | `m-2` |
| Not sooner than later | `m-3` | |
| Group | | |
## History
| Model | Retirement date |
|:--|--:|
| `m-1` | 2026-06-13 |
| a \| b `m-4` | 3 October 2026 |
| Name | Price |
"""


def test_retirements(spark):
    rows = extract.retirements(spark.createDataFrame([("p", "acme", PAGE)], "source string, vendor string, markdown string")).collect()
    got = {(r.model, tuple(r.aliases), r.shutdown, tuple(r.replacements), r.section) for r in rows}
    assert got == {("m-1", ("m-1-x",), D(2026, 6, 13), ("m-2",), "2026-01-05: old models"), ("m-4", (), D(2026, 10, 3), (), "History")}


def test_changelogs(spark):
    body = "# Log\n## 2026\n### March 4\n- one [a](https://x/1)\n- two\n### 2026-02\nProse about *it*.\n# Undated\nnothing\n"
    mdx = '<Update label="June 1, 2026">\nA breaking change.\n</Update>\n'
    pages = spark.createDataFrame([("s", "v", body), ("m", "v", mdx), ("e", "v", None)], "source string, vendor string, body string")
    got = {(r.source, r.date_text, r.title, r.url) for r in extract.changelog(pages).collect()}
    assert got == {("s", "2026-03-04", "one a", "https://x/1"), ("s", "2026-03-04", "two", ""), ("s", "2026-02", "Prose about it .", ""), ("m", "2026-06-01", "A breaking change.", "")}
    releases = json.dumps([{"name": "", "tag_name": "v1", "body": "x", "html_url": "u", "published_at": "2026-01-02T00:00:00Z", "draft": False, "prerelease": False}, {"tag_name": "v2", "draft": True}])
    assert [(r.date_text, r.title) for r in extract.releases(spark.createDataFrame([("g", "v", releases)], "source string, vendor string, body string")).collect()] == [("2026-01-02", "v1")]
    assert extract.leads(extract.changelog(pages), "2026-05-01").count() == 1


def test_evidence(spark):
    kind = "id string, source_url string, evidence array<struct<url:string,text:string>>"
    rows = [("ok", "u1", [(None, "Old *thing* goes")]), ("missing", "u1", [("u1", "never said")]), ("error", "u2", [(None, "x")]), ("none", "u1", [])]
    pages = spark.createDataFrame([("u1", "<p>The old <b>thing</b> goes away.</p>", ""), ("u2", None, "timeout")], "url string, text string, error string")
    assert {r.id: r.status for r in evidence.check(spark.createDataFrame(rows, kind), pages).collect()} == {"ok": "ok", "missing": "missing", "error": "error", "none": "no_evidence"}


def test_containment(spark):
    quotes = spark.createDataFrame([(1, "b c d e f"), (2, "c d"), (3, "x y z w v u")], "q int, text string")
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "aab c d e fg"), (3, "nothing"), (4, ""), (5, None)], "t int, text string")
    assert {(r.q, r.t) for r in evidence.containment(quotes, texts, "q", "t").collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


PINS = [
    ("requirements.txt", "Foo_Bar[x]>=1.2,<2 ; python_version>'3'\n# no\n-r other\nbaz==3\nplain\n", [("baz", "3.x"), ("foo-bar", "1.2"), ("plain", "")]),
    ("package.json", '{"dependencies": {"@a/b": "^1.2.3"}, "devDependencies": {"c": "2"}}', [("@a/b", "1.2.3"), ("c", "2.x")]),
    ("package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/b": {"version": "2.0.0"}}}', [("a", "1.0.0"), ("b", "2.0.0")]),
    ("pyproject.toml", '[project]\ndependencies = ["A.b>=1.0"]\n[tool.poetry.dependencies]\npython = "^3.9"\nq = {version = "^2.1"}\n', [("a-b", "1.0"), ("q", "2.1")]),
    ("poetry.lock", '[[package]]\nname = "X"\nversion = "1.1"\n', [("x", "1.1")]),
    ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n\texample.com/c/d v0.1.0 // indirect\n)\nreplace example.com/c/d => github.com/e/f v0.2.0\n", [("github.com/a/b", "1.2.3"), ("github.com/e/f", "0.2.0")]),
    ("yarn.lock", '"@a/b@^1.0.0":\n  version "1.0.5"\n  resolved "x"\n\nc@2:\n  version "2.2.0"\n', [("@a/b", "1.0.5"), ("c", "2.2.0")]),
    ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.1)\n      rack (~> 2)\n", [("rails", "7.0.1")]),
    ("composer.lock", '{"packages": [{"name": "a/b", "version": "v1.0"}]}', [("a/b", "1.0")]),
    ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n', [("serde", "1.0.1")]),
    ("package.json", "{broken", []),
]


@pytest.mark.parametrize(("name", "body", "want"), PINS)
def test_pins(name, body, want):
    assert deps.pins(f"x/{name}", body) == want


def test_locks_beat_manifests(spark):
    files = spark.createDataFrame([("a/package.json", '{"dependencies": {"x": "1"}}'), ("a/package-lock.json", '{"packages": {"node_modules/x": {"version": "1.5.0"}}}'), ("b/package.json", '{"dependencies": {"x": "2"}}'), ("readme", "x")], "path string, text string")
    got = {(r.dir, r.version) for r in deps.effective_pins(deps.dependency_pins(files)).collect()}
    assert got == {("a", "1.5.0"), ("b", "2.x")}


RECORD = """id: acme-1
vendor: Acme
surface: api
kind: model
severity: breaking
effective: 2026-03-04
summary: Gone
signatures: [m-1, m-1-x]
source_url: https://acme.example/log#x
verified: true
verified_by: Ann
verified_on: '2026-01-01'
evidence: [plain words, {url: 'https://other.example', text: 'other words'}]
context: [one, [two, three]]
"""


def test_records_and_code(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b.yaml").write_text("id: z\nkind: nothing\nverified: true\n")
    (tmp_path / "r" / "c.yml").write_text(RECORD)
    rows = records.read(spark, f"{tmp_path}/r").orderBy("load_ordinal").collect()
    assert [r.id for r in rows] == ["acme-1", "z"] and rows[0].effective == D(2026, 3, 4) and rows[0].context == [["one"], ["two", "three"]]
    assert [(e.url, e.text) for e in rows[0].evidence] == [("https://acme.example/log#x", "plain words"), ("https://other.example", "other words")]
    checked = {r.id: r.violations for r in feed.violations(records.read(spark, f"{tmp_path}/r")).collect()}
    assert checked["acme-1"] == [] and {"kind", "severity", "effective", "unbacked"} <= set(checked["z"])
    assert feed.evidence_urls(records.read(spark, f"{tmp_path}/r").where("id = 'acme-1'")).count() == 2
    src = tmp_path / "repo" / "src"
    src.mkdir(parents=True)
    (src / "a.py").write_bytes(b"x = 'm-1'\n\xff# y\n")
    (src / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": "m-1"}, {"cell_type": "code", "source": ["!pip\n", "m-1"]}]}))
    (src / "skip.py").write_text("m-1")
    (tmp_path / "repo" / "node_modules").mkdir()
    (tmp_path / "repo" / "node_modules" / "b.js").write_text("m-1")
    files = code.files(spark, f"{tmp_path}/repo", ["skip.py"])
    assert sorted(r.path for r in files.collect()) == ["src/a.py", "src/n.ipynb"]
    assert sorted((r.path, r.line_no, r.line, r.cell) for r in code.code_lines(files).collect()) == [("src/a.py", 1, "x = 'm-1'", ""), ("src/a.py", 2, "# y", ""), ("src/n.ipynb", 1, "", "cell 2, line 1"), ("src/n.ipynb", 2, "m-1", "cell 2, line 2")]


def test_reports(spark):
    sites = spark.createDataFrame([("r", "a.py", 1, "m", 0, "x m", "use", ""), ("r", "tests/a.py", 2, "m", 0, "m", "use", ""), ("r", "t.json", 3, "m", 0, "m", "listed", "")], "record_id string, file string, line int, signature string, start int, snippet string, tier string, via string")
    known = spark.createDataFrame([("r", "breaking", "Gone", "u", D(2026, 1, 1))], "id string, severity string, summary string, source_url string, effective date")
    r = report.split_counts(sites).head()
    assert (r.sites, r.in_code, r.listed, r.in_test) == (3, 1, 1, 1)
    assert tuple(report.totals(sites, known).head()) == (1, 1, 0)
    assert report.fit_sites(sites, 10_000) == 5 and report.fit_sites(sites, 1) == 0
    more = known.select("*", F.lit("V").alias("vendor"), F.lit("rest").alias("kind"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("fix_hint"), F.lit(True).alias("verified"), F.lit("A. Person").alias("verified_by"), F.lit(None).cast("date").alias("verified_on"))
    lines = report.sarif(sites, more, "changelens").collect()
    assert sorted(r.place for r in lines) == list(range(1, len(lines) + 1))
    out = json.loads("\n".join(r.line for r in sorted(lines, key=lambda r: r.place)))
    assert out["runs"][0]["tool"]["driver"]["rules"][0]["help"]["text"] == "See source.\n\nSource: u (verified by A. Person)"
    assert [x["level"] for x in out["runs"][0]["results"]] == ["error", "note", "error"] and len(out["runs"][0]["tool"]["driver"]["rules"]) == 1
    assert report.first_by_line(sites).count() == 3

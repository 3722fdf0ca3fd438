import random
import time

import pytest
from pyspark.sql import functions as F

from changelens.functions.text import lines
from changelens.operators import code_context, lexing, scan, snapshot, tokens


def uses(text, path="src/a.ts"):
    return sorted((r["name"], r["line"], r["bound"]) for r in code_context.script_names(path, text) if r["kind"] == "load")


def consts(text):
    return sorted((r["name"], r["of"], r["line"], r["scope_start"]) for r in code_context.script_names("a.ts", text) if r["kind"] == "const")


def test_tokens_of_scripts():
    kinds = lambda text: [(t.kind, t.value) for t in lexing.tokens(".ts", text)]
    assert kinds("a / b / c") == [("word", "a"), ("mark", "/"), ("word", "b"), ("mark", "/"), ("word", "c")]
    assert ("text", "/[/'\"]\\//g") in kinds("x = /[/'\"]\\//g; y") and ("text", "/a'/") in kinds("return /a'/")
    assert [k for k, _ in kinds("`a${ {b: `c`} }d` // e")] == ["text", "open", "open", "word", "mark", "text", "close", "close", "text", "comment"]
    assert kinds("'unclosed\nx")[-1] == ("word", "x") and kinds("`never ends ${")[0][0] == "text" and kinds("/* never ends")[0][0] == "comment"


def test_constants_of_scripts():
    assert consts("const A: Record<string, { a: 'x' }> = 'm-1'\n") == [("A", "'m-1'", 1, None)]
    assert consts("const " + "A: " + "string | " * 5000 + "null = 'm-1'\n")[0][:2] == ("A", "'m-1'")
    assert consts("export const T = `a\nm-1\n${b} z`\n")[0][:2] == ("T", "`a\nm-1\n${b} z`")
    assert consts("const f = (x: string) => 'm-1'\nlet n: number\nother = 'm-1'\n") == []


@pytest.mark.parametrize("text, found", [
    ("function f(x) {\n  const M = 'm-1'; if (x) {\n    y()\n  }\n  switch (x) {\n    case M:\n      go(M)\n  }\n}\nM\n", [("M", 6, 2), ("M", 7, 2), ("M", 10, None)]),
    ("const M = 'm-1'\nfunction f() {\n  const M = other()\n  go(M)\n}\ngo(M)\n", [("M", 6, None)]),
    ("const M = 'm-1'\ng({ M: 1, a: M, b: c ? M : d })\nx.M\nM::y\n", [("M", 2, None), ("M", 4, None)]),
    ("const M = 'm-1'\n// M\n/* M */ 'M'; /M/.test(a)\ngo(`${M}`)\n", [("M", 4, None)]),
    ("const M = 'm-1'\nfunction f(M: string) {}\n", []),
])
def test_uses_of_scripts(text, found):
    assert [u for u in uses(text)] == found


def test_time_grows_with_the_text():
    begun = time.time()
    local = "function f() {\n" + "".join(f"  const k{i} = 'm-1'\n" for i in range(8000)) + "}\n"
    assert len(consts(local)) == 8000
    generated = "export const T = {\n" + "".join(f"  k{i}: call('m-1'),\n" for i in range(3000)) + "};\n"
    assert code_context.list_spans(".ts", generated) == []
    for hostile in ("`" * 20_000, "'" * 20_000, "/" * 20_000, "{" * 20_000, "`${" * 20_000, "\\" * 20_000, "let a: " * 5000, "let a: {" * 5000, "import a, {b as " * 5000, "import {" * 5000, '"' + " " * 50_000, "[" + " " * 50_000 + '"m-1"' + " " * 50_000 + "]"):
        code_context.script_names("a.ts", hostile)
        code_context.list_spans(".ts", hostile)
        code_context.comment_spans(".py", hostile)
    assert time.time() - begun < 8


@pytest.mark.parametrize("space", [" ", " " * 25, " " * 60, "\n" * 30])
def test_white_space_changes_no_tier(space):
    listed = lambda text: len(code_context.list_spans(".py", text))
    assert listed(f'x = ["m-1"{space}if x else "b"{space}]') == 1 and listed(f'T = ["m-1"{space}, "b"]') == 2
    assert listed(f'g{space}["m-1"]') == 0 and listed(f'return{space}["m-1"]') == 1
    assert len(code_context.comment_spans(".py", f'"""m-1"""{space}\n')) == 1


def test_documentation_by_the_syntax_tree():
    spans = lambda text: [(r["line"], r["start"], r["stop"]) for r in code_context.comment_spans(".py", text)]
    assert spans('def f():\n    "é m-1"; g("m-1")\n') == [(2, 4, 11)]
    assert spans('f(\n  "m-1"\n)\nx = (\n"m-1"\n)\n') == []
    assert spans('"""a\nm-1\n"""\n') == [(1, 0, 4), (2, 0, 3), (3, 0, 3)]
    assert spans('def (\n"m-1"\n') == [] and spans('x y\n"m-1"\nz\n') == [(2, 0, 5)]


NASTY = ["mcp", "mcp__", "A", "a", "Z", "0", "9", "100", "Za", "_", "\\", "(", "a_", "__", "[", "-", "x.y", "1.", "mcp__a__b"]


def test_no_signature_stops_a_scan(spark, monkeypatch):
    draw = random.Random(3)
    signatures = NASTY + ["".join(draw.choices("aAz09_-.mcp/", k=draw.randint(1, 5))) for _ in range(40)]
    texts = ["use gpt-4 and mcp here", "A a Z 0 9 100 Za _ a_ __ mcp__ mcp__srv__A x.y 1. 1.2", *(" ".join(draw.choices(signatures, k=6)) for _ in range(60)), *("".join(draw.choices(signatures, k=4)) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, line string")
    records = spark.createDataFrame([(f"r{i}", [s], "model" if i % 2 else "rest") for i, s in enumerate(dict.fromkeys(signatures))], "id string, signatures array<string>, kind string")
    found = []
    for few, small in ((20_000, 50_000), (0, 50_000), (0, 0)):
        monkeypatch.setattr(tokens, "SCAN_ROWS", few)
        monkeypatch.setattr(tokens, "BROADCAST_ROWS", small)
        hits = tokens.token_hits(rows, tokens.signature_table(records), ["n"])
        found.append(sorted(map(tuple, hits.select("n", "record_id", "start").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_prose_of_data_files(spark):
    sentence = "the m-1 model is retired and all callers have to move on by the end of the year"
    cases = [
        (sentence, ".yaml", True), (f"a: '{sentence}'", ".yaml", True), (f"don't say '{sentence}", ".yaml", True), (f'"a": "{sentence}", "b": 1', ".json", True), (f'"it\'s \\"{sentence}\\"', ".json", True),
        ("model: m-1", ".yaml", False), ("model: m-1 # which is retired and all callers have to move on by the end of the year", ".yaml", False), (f"summary: m-1 {sentence[8:]}", ".yaml", True),
        ("- m-1 which we have used for the whole of the last year and for some of this", ".yaml", False), ("run: tool --model m-1 for the whole of the test suite in every one of the jobs", ".yaml", False),
        (f"[m-1, {sentence[8:]}]", ".toml", False), (f"The older models, m-1 {sentence[8:]}", ".toml", True), ('{"a": "b", "c": "m-1", "d": "the model is retired and all callers have to move on by the end"}', ".json", False),
    ]
    rows = spark.createDataFrame([(i, line, line.index("m-1"), line.index("m-1") + 3, s) for i, (line, s, _) in enumerate(cases)], "i int, line string, start int, stop int, suffix string")
    got = {r.i: r.p for r in rows.select("i", scan.prose(F.col("line"), F.col("start"), F.col("stop"), F.col("suffix")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_schemas_in_one_form():
    tool = {"inputSchema": {"required": ["b", "a"], "properties": {"items": True, "properties": {"type": "object", "additionalProperties": True}, "required": False, "x": {"items": False, "required": ["b", 1]}}, "anyOf": [{"items": True}]}}
    snapshot.put_in_form(tool)
    assert tool == {"inputSchema": {"required": ["a", "b"], "properties": {"items": {}, "properties": {"type": "object", "additionalProperties": True}, "required": {"not": {}}, "x": {"items": {"not": {}}, "required": ["b", 1]}}, "anyOf": [{"items": {}}]}}
    deep = {}
    for _ in range(100_000):
        deep = {"items": deep}
    snapshot.put_in_form(deep)


def test_constants_over_files(spark):
    files = [("src/a.ts", "export const M: string = 'm-1'\nfunction f() {\n  const M = `m-1`\n  return g(M)\n}\ng(M)\n"), ("src/b.js", "import { M as N, type X } from './a'\nimport D from './a'\nif (y) { const N = 1; g(N) }\ng(N)\n")]
    table = spark.createDataFrame([(p, p[p.rindex(".") :], t) for p, t in files], "path string, suffix string, text string")
    records = spark.createDataFrame([("r", ["m-1"], "rest")], "id string, signatures array<string>, kind string")
    rows = lines(table, "text", ["path"]).select(F.col("path").alias("file"), F.col("line_no").alias("n"), "line")
    hits = tokens.token_hits(rows, tokens.signature_table(records), ["file", "n"]).drop("line").withColumnRenamed("n", "line")
    got = {(r.file, r.line, r.via) for r in code_context.constant_uses(hits, table).collect()}
    assert got == {("src/a.ts", 4, "M (src/a.ts:3)"), ("src/a.ts", 6, "M (src/a.ts:1)"), ("src/b.js", 4, "N (src/a.ts:1)")}


def test_uses_of_constants_broadcast_nothing(spark):
    files = spark.createDataFrame([("src/a.ts", ".ts", "export const A = 'nova-4'\ng(A)\n"), ("src/b.js", ".js", "import { A } from './a'\ng(A)\n")], "path string, suffix string, text string")
    hits = spark.createDataFrame([("r", "nova-4", "src/a.ts", 1)], "record_id string, signature string, file string, line int")
    found = scan.sites(hits, files)
    assert {(r.file, r.line, r.via) for r in found.collect()} == {("src/a.ts", 1, ""), ("src/a.ts", 2, "A (src/a.ts:1)"), ("src/b.js", 2, "A (src/a.ts:1)")}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_loads_of_other_names_are_left_out():
    rows = code_context._linked(code_context.python_names("from m import B\nA = 'x'\nf(A, B, c)\n"))
    assert [(r["name"], r["kind"]) for r in rows] == [("B", "import"), ("A", "const"), ("A", "load"), ("B", "load")]

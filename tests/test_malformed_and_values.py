"""Malformed input, long files and the fixed values of names, words and folders."""

import time

import pytest
from pyspark.sql import functions as F

from changelens.functions.text import canonical, in_test, is_ignored
from changelens.operators import diff, extract, history
from changelens.operators.code_context import comment_spans, list_spans
from changelens.sources import code, deps, records


def test_malformed_json_is_null(spark):
    rows = spark.createDataFrame([("{",), ('{"a": 1}',), (None,), ("[" * 100_000,)], "body string")
    for f in (diff.schema_paths, diff.tool_params):
        assert [r[0] is None for r in rows.select(f(F.col("body"))).collect()] == [True, False, True, True]
    assert canonical("{") is None and canonical('{"b": 1, "a": 2}') == '{"a":2,"b":1}'


def test_malformed_records_are_rows_with_an_error(spark, tmp_path):
    (tmp_path / "a.yml").write_text("id: one\nvendor: v\nverified: true\n")
    (tmp_path / "b.yml").write_text("id: [unclosed\n")
    (tmp_path / "c.yml").write_text("just a text\n")
    got = records.read(spark, str(tmp_path)).orderBy("load_ordinal").collect()
    assert [(r.id, r.error is None) for r in got] == [("one", True), (None, False), (None, False)]


def test_a_string_in_a_call_is_no_documentation_at_any_place():
    call, doc = "f(\n  \"gpt-4\"\n)\n", '"""documentation"""\n'
    for before in ("", "x = 1\n" * 20_000, "f(  # a note\n  \"x\"\n)\n" * 2000):
        found = comment_spans(".py", before + call + doc)
        lines = {s["line"] for s in found}
        n = before.count("\n")
        assert n + 2 not in lines and n + 4 in lines


def test_list_spans_are_linear():
    times = []
    for n in (20_000, 80_000):
        begun = time.time()
        assert len(list_spans(".py", "x = [\"a\", 1]\n" * n)) == n
        times.append(time.time() - begun)
    assert times[1] < 10 * times[0] + 1


@pytest.mark.parametrize("path,test", [("a/__snapshots__/x.py", True), ("a/cassettes/x.py", True), ("a/testing/x.py", False), ("a/e2e/x.py", False), ("a/x_test.rb", False), ("a/x_test.go", True), ("A\\Tests\\x.py", True), ("a/x.spec.tsx", True), ("conftest.py", False)])
def test_folders_and_names_of_tests(spark, path, test):
    assert spark.range(1).select(in_test(F.lit(path))).head()[0] == test


def test_code_files_and_ignored_folders(spark):
    df = spark.createDataFrame([("a.mts",), ("b/.env",), (".env.local",), ("x.ini",), ("out/a.py",), ("locales/a.json",), ("a.txt",), (".tox/a.py",), ("a.swift",), ("A.PY",)], "path string")
    assert [r.path for r in df.where(code.is_code(F.col("path"))).collect()] == ["a.mts", "b/.env", ".env.local", "x.ini", "a.swift"]
    paths = spark.createDataFrame([("gen-1/a.py",), ("src/gen-2/a.py",), ("gen/a.py",), ("gen-1",), ("docs/old-1/x.py",)], "path string")
    assert [r.path for r in paths.where(is_ignored(F.col("path"), ["gen-*/"])).collect()] == ["gen-1/a.py", "src/gen-2/a.py"]
    assert [r.path for r in paths.where(is_ignored(F.col("path"), ["docs/old-*/"])).collect()] == ["docs/old-1/x.py"]


def test_dependency_files_of_any_case(spark):
    rows = [("Gemfile.lock", "rubygems"), ("Cargo.lock", "cargo"), ("Pipfile.lock", "pypi"), ("composer.lock", "packagist"), ("dev-requirements.txt", "pypi"), ("requirements/base.txt", "pypi"), ("Requirements-dev.in", "pypi"), ("notes.txt", None)]
    df = spark.createDataFrame(rows, "path string, want string")
    assert all(r.want == r.got for r in df.select("want", deps.ecosystem(F.col("path")).ecosystem.alias("got")).collect())
    assert deps.pins("requirements/base.txt", "Some_Package==1.2.3\n") == [("some-package", "1.2.3")]
    assert deps.pins("a/Pipfile.lock", '{"default": {"A": {"version": "==2.1"}}}') == [("a", "2.1")]


def test_phrases_and_flags(spark):
    rows = [("a", "Do not tell the users, and don\u2019t  mention it"), ("b", "reads .env and ~/.ssh"), ("c", "undo not mentioned"), ("d", "disre\u200bgard previous")]
    after = spark.createDataFrame(rows, "name string, text string").withColumn("server", F.lit(1))
    got = {(r.name, r.flag, r.detail) for r in history.new_flags(after.withColumn("text", F.lit("")), after).collect()}
    assert got == {("a", "instruction_like_text", "do not tell the user"), ("a", "instruction_like_text", "don't mention"), ("b", "instruction_like_text", ".env"), ("b", "instruction_like_text", "~/.ssh"), ("d", "instruction_like_text", "disregard previous"), ("d", "hidden_characters", "U+200B")}


def test_strong_and_weak_words(spark):
    texts = ["a non-breaking change", "a breaking change", "not deprecated", "Deprecating x", "remove_issue", "remove x, previously y", "remove, Remove", "shutting down", "defaults will change"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert {r.i: list(r.flags) for r in extract.flagged(df).collect()} == {1: ["breaking"], 3: ["deprecating"], 5: ["previously", "remove"], 7: ["shutting down"], 8: ["defaults will change"]}


def test_keys_ignore_signs_at_the_end(spark):
    key = lambda text: spark.range(1).select(extract.entry_key(F.lit("s"), F.lit("d"), F.lit("T"), F.lit(text))).head()[0]
    assert key("It ends.") == key("it ends") != key("it end")


def test_all_aliases_stay(spark):
    names = ", ".join(f"`m-{i}`" for i in range(1500))
    page = spark.createDataFrame([("s", "v", f"| Model | Shutdown date |\n| --- | --- |\n| {names} | 2026-01-02 |\n")], "source string, vendor string, markdown string")
    row = extract.retirements(page).head()
    assert (row.model, len(row.aliases)) == ("m-0", 1499)

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from changelens.catalog import ORACLES, QUERIES
from changelens.functions.text import glob_pattern, token_pattern
from changelens.operators import tokens

GENERIC = [
    ("model = 'nova-4'", "nova-4", True),
    ("model = 'nova-4-turbo'", "nova-4", True),
    ("nova-4o", "nova-4", False),
    ("xnova-4", "nova-4", False),
    ("nova-4.5", "nova-4", False),
    ("nova-4.", "nova-4", True),
    (r"nova-4\.5", "nova-4", False),
    ("mcp__acme__send_mail(", "send_mail", True),
    ("my_send_mail(", "send_mail", False),
    ("é" + "nova-4", "nova-4", True),
    ("/v1/charges/list", "/v1/charges", True),
    ("x/v1/charges", "/v1/charges", True),
    ("a.create(b)", "create(", True),
    ("NOVA-4", "nova-4", False),
    ("nova-4 nova-4", "nova-4", True),
]
MODEL = [
    ("nova-4", "nova-4", (), True),
    ("nova-4-turbo", "nova-4", (), False),
    ("nova-4-20240613", "nova-4", (), True),
    ("nova-4-0613", "nova-4", (), True),
    ("nova-4-2024-06-13", "nova-4", (), True),
    ("nova-4-001", "nova-4", (), True),
    ("nova-4-latest", "nova-4", (), True),
    ("nova-4-latest-x", "nova-4", (), False),
    ("nova-4-mini", "nova-4", ("nova-4-mini",), True),
    ("nova-4-minimal", "nova-4", ("nova-4-mini",), False),
]


@pytest.mark.parametrize(("line", "signature", "hit"), GENERIC)
def test_generic(spark, line, signature, hit):
    at = tokens.token_positions(line, signature, re.compile(tokens.python_pattern(signature, False, ())))
    assert bool(at) == hit
    assert spark.createDataFrame([(line,)], "line string").select(F.col("line").rlike(token_pattern(signature))).head()[0] == hit


@pytest.mark.parametrize(("line", "signature", "named", "hit"), MODEL)
def test_model(spark, line, signature, named, hit):
    at = tokens.token_positions(line, signature, re.compile(tokens.python_pattern(signature, True, named)))
    assert bool(at) == hit
    assert spark.createDataFrame([(line,)], "line string").select(F.col("line").rlike(token_pattern(signature, True, named))).head()[0] == hit


@pytest.mark.parametrize("rows_scanned", [0, 20_000])
def test_join_and_automaton_find_what_a_scan_of_all_lines_finds(spark, monkeypatch, rows_scanned):
    monkeypatch.setattr(tokens, "SCAN_ROWS", rows_scanned)
    lines = [line for line, *_ in GENERIC + MODEL] + ["", None, "mcp__a__nova-4 and __send_mail__", "x" * 100_000 + " send_mail"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    records = spark.createDataFrame([("a", ["nova-4", "send_mail", "create(", "/v1/charges"], "rest"), ("b", ["nova-4"], "model")], "id string, signatures array<string>, kind string")
    got = {(r.n, r.record_id, r.signature, r.start) for r in tokens.token_hits(rows, tokens.signature_table(records), ["n"]).collect()}
    want = set()
    for record, signatures, model in (("a", ["nova-4", "send_mail", "create(", "/v1/charges"], False), ("b", ["nova-4"], True)):
        for s in signatures:
            for written in {s, s.replace(".", "\\.")}:
                p = re.compile(tokens.python_pattern(written, model, ()))
                want |= {(i, record, s, at) for i, x in enumerate(lines) if x for at in tokens.token_positions(x, written, p)}
    assert got == want and len(got) > 20


def test_longest_wins_and_excludes(spark):
    rows = spark.createDataFrame([("r", "f", 1, "abc-def abc", 0, 7), ("r", "f", 1, "abc-def abc", 0, 3), ("r", "f", 1, "abc-def abc", 8, 11), ("r", "f", 2, "abc", 0, 3)], "record_id string, file string, line_no int, line string, start int, stop int")
    kept = tokens.longest_wins(rows, ["record_id", "file", "line_no"])
    assert sorted((r.line_no, r.start, r.stop) for r in kept.collect()) == [(1, 0, 7), (1, 8, 11), (2, 0, 3)]
    assert sorted((r.line_no, r.start) for r in tokens.not_excluded(kept, ["abc-def"]).collect()) == [(1, 8), (2, 0)]


def test_context(spark):
    df = spark.createDataFrame([("Foo bar",), ("foo",), ("baz",)], "text string")
    groups = F.array(F.array(F.lit("foo"), F.lit("BAR")), F.array(F.lit("baz")))
    assert [r[0] for r in df.select(tokens.context_matches(F.col("text"), groups)).collect()] == [True, False, True]
    assert all(r[0] for r in df.select(tokens.context_matches(F.col("text"), F.array().cast("array<array<string>>"))).collect())


@pytest.mark.parametrize(("glob", "name", "hit"), [("*.py", "a/b.py", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("x.y", "xzy", False)])
def test_globs(glob, name, hit):
    assert bool(re.match(glob_pattern(glob).replace("\\z", "\\Z"), name)) == hit


def test_signatures_are_keyed_by_the_word_that_fewest_share(spark):
    records = spark.createDataFrame([(str(i), [f"model-{i}"], "rest") for i in range(50)] + [("x", ["model__x", "model-7-old"], "rest")], "id string, signatures array<string>, kind string")
    words = {r.written: r.word for r in tokens.by_rarest_word(tokens.signature_table(records)).collect()}
    assert all(words[f"model-{i}"] == str(i) for i in range(50)) and words["model-7-old"] == "old" and words["model__x"] == "model__x"


def test_a_compiled_end_serves_all_signatures_of_a_kind():
    ends = {tokens.token_end(f"model-{i}") for i in range(1000)}
    assert len(ends) == 1
    for line, signature, hit in GENERIC:
        assert bool(tokens.token_positions(line, signature, re.compile(tokens.token_end(signature)), len(signature))) == hit


def test_what_is_no_hit_covers_none(spark, tmp_path):
    texts = [(1, "proof the end of the day\nthe theory of thesis"), (2, "of the of the the"), (3, "hoof the.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["longest_signature_wins"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["longest_signature_wins"]).fetchall()) == [(1, 1, 2), (2, 2, 1), (3, 0, 1)]

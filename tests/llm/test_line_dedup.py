from collections import Counter

import pytest
from pyspark.sql import functions as F

from changelens.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, h1 long, lines string"


def plain(texts, min_docs, min_chars=1):
    key = lambda line: line.strip(SPACE).translate(FOLD)
    lines = [(t or "").split("\n") for t in texts]
    counts = Counter(k for some in lines for k in {key(x) for x in some})
    gone = {k for k, n in counts.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(some), sum(key(x) in gone for x in some), "\n".join(x for x in some if key(x) not in gone)) for some in lines]


TEXTS = [None, "", "\n", "A\nb\na", " a \nÉ", "a\r\né", "\x0ba\x0c\nİ", " a\nK", "b\n\n\nb", "c", "c", "c", "\n".join(["a", "x"] * 3000), "a" * 50_000, "b\n" * 5000, "K\nk", "ß\nSS\nss", "end\n"]


@pytest.mark.parametrize("batches", [1, 2, 3, 4, 7])
def test_against_plain_python(spark, batches):
    df = spark.createDataFrame([(i, t, "mine", 5, None) for i, t in enumerate(TEXTS)], SCHEMA)
    got = line_dedup.drop_repeated(df, F.pmod("doc_id", F.lit(batches)), batches, 3).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == plain(TEXTS, 3)
    assert {(r.h1, r.lines) for r in got} == {(5, None)}


def test_other_limits_and_the_join_of_many_keys(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, None, None, None) for t in TEXTS], SCHEMA)  # one id for all rows
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    for min_docs, min_chars in ((1, 0), (2, 2), (3, 0)):
        got = line_dedup.drop_repeated(df, F.pmod(F.xxhash64("text"), F.lit(3)), 3, min_docs, min_chars=min_chars).collect()
        assert Counter((r.n_lines, r.n_dropped, r.text) for r in got) == Counter(plain(TEXTS, min_docs, min_chars))
    assert line_dedup.drop_repeated(df.limit(0), F.lit(0), 2, 1).count() == 0


def test_frequent_lines_are_counted_no_further_and_runs_compacted(spark):
    runs = line_dedup.Runs(spark, 2)
    batch = spark.createDataFrame([("a",), ("a\nb",)], "text string")
    for n in range(1, 6):
        runs.add(line_dedup.document_counts(batch))
        assert len(runs.levels) <= n.bit_length()
    counts = sorted(r.docs for _, run in runs.levels for r in run.collect())
    # a is frequent in the first batch and never added again; b's run says so from the second on
    assert counts == [2, 2] and runs.repeated().count() == 2


def test_merging_runs_needs_no_shuffle(spark):
    runs = line_dedup.Runs(spark, 9)
    batch = spark.createDataFrame([("a\nc",), ("a\nb",)], "text string")
    for _ in range(3):
        runs.add(line_dedup.document_counts(batch))
    plan = runs.repeated()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_no_python_on_the_path(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup.drop_repeated(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)), 2, 10)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

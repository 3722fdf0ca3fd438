import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import quality
from changelens.llm.queries import TRAIN, op1_quality


def plain_scores(train, texts):
    """The discriminant written out: densities by inverse and determinant instead of Cholesky factors. train: (text, label)."""
    x = np.array([quality.statistics(t) for t, _ in train])
    y = np.array([label for _, label in train])
    d = x.shape[1]
    scatter = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    share = [(y == k).mean() for k in (0, 1)]
    pooled = share[0] * scatter[0] + share[1] * scatter[1]
    logs = []
    for k in (0, 1):
        s = (1 - quality.TO_POOLED) * scatter[k] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_DIAGONAL) * s + (quality.TO_DIAGONAL * np.trace(s) / d + 1e-6 * max(1, np.trace(pooled) / d)) * np.eye(d)
        z = np.array([quality.statistics(t) for t in texts]) - x[y == k].mean(axis=0)
        logs.append(np.log(share[k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_query_against_the_formula_and_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = sorted(docs)
    want = dict(zip(ids, plain_scores([(docs[i], q) for i, q in labels.items() if i in docs and not held(i)], [docs[i] for i in ids]), strict=True))
    rows = op1_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == ids
    for r in rows:
        assert r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in tested]) > 0.95


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "some words here", "x"), (4, "W " * 100_000, "x"), (5, "🙂".encode("utf-16", "surrogatepass").decode("utf-16"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (2, None, 0), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    both = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(df, none, "true").collect()] == [0.5] * 6
    assert [r.score for r in quality.classify(df, some, "true").collect()] == [0.0] * 6  # only class 0 has rows
    got = quality.classify(df, both, "true").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(df.limit(0), both, TRAIN).count() == 0
    kept = quality.keep_good(df, none, F.lit(True))
    assert kept.columns == df.columns and kept.count() == 6


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "!!!", "1", "\n\n\n", "é", "A" * 100_000):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.FEATURES)

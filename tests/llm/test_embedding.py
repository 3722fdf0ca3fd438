import numpy as np
import pytest

from changelens.llm import embedding
from changelens.llm.queries import op4_embedding


def brute(rows, cosine=0.93):
    """rows: (id, vector, label) -> {id: (links, component)} by comparing all with all."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    unit = [None if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in rows]
    for i in range(n):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                near[i, j] = near[j, i] = unit[i] @ unit[j] >= cosine
    label = [r[0] for r in rows]
    for _ in range(n):
        before = list(label)
        for i in range(n):
            label[i] = min([label[i], *(label[j] for j in np.flatnonzero(near[i]))])
        if label == before:
            break
    return {r[0]: (int(near[i].sum()), label[i]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [2048, 40])
def test_query_against_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op4_embedding(spark, sf_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * side
    unit, half, least = embedding.directions(64, 0.93)
    assert ((np.abs(a @ unit - b @ unit) <= half).sum(axis=1) >= least).mean() > 0.99
    counts = {}
    for rows, found in embedding.collisions((a @ unit)[:100], b @ unit, half):
        counts |= {int(r): f for r, f in zip(rows, found, strict=True)}
    want = (np.abs((a @ unit)[:100, None] - (b @ unit)[None]) <= half).sum(axis=2)
    assert (np.array([counts[i] for i in range(100)]) == want).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 3), (2, [1.0, 0.0], 3), (2, [2.0, 0.01], 3), (None, [1.0, 0.0], 3), (5, [0.0, 0.0], 3), (6, None, 3), (7, [1.0, None], 3), (8, [nan, 1.0], 3), (9, [inf, 1.0], 3), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 3), (None, [0.0, 1.0], 4), (13, [], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.link(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 13)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, False), *alone], key=str)
    assert embedding.link(df.limit(0)).count() == 0

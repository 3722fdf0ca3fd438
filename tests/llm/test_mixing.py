import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from changelens.llm import mixing
from changelens.llm.queries import ORACLES, op7_mixing


def spread(budget, caps, weights):
    """Deal a budget to children by weight; those that are full drop out one by one."""
    given, open_, left = {}, {k for k in caps if weights[k] > 0}, budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = sorted((caps[k] / weights[k], k) for k in open_ if caps[k] * total <= left * weights[k])
        if not full:
            return given | {k: left * weights[k] // total for k in open_}
        k = full[0][1]
        given[k], left = caps[k], left - caps[k]
        open_.remove(k)
    return given


def plain(rows, weights, percent, max_epochs, seed):
    """rows: (id, path, tokens) -> copies of each row, by walking the tree."""
    leaves = Counter()
    for _, path, n in rows:
        leaves[path] += n
    depth = len(next(iter(leaves), ()))
    weight = lambda p: weights.get(p, 1)
    cap = {p: n * max_epochs for p, n in leaves.items() if all(weight(p[: i + 1]) > 0 for i in range(depth))}
    budgets = {(): sum(leaves.values()) * percent // 100}
    for i in range(depth):
        below = defaultdict(Counter)
        for p, c in cap.items():
            below[p[:i]][p[: i + 1]] += c
        budgets = {k: v for parent, caps in below.items() for k, v in spread(budgets[parent], caps, {p: weight(p) for p in caps}).items()}
    out = {}
    for path, n in leaves.items():
        full, rest = divmod(budgets.get(path, 0), n) if n else (0, 0)
        place = {i: f"{hashlib.md5(f'{seed}:{full}:{i}'.encode()).hexdigest()}:{i}" for i, p, _ in rows if p == path}
        upto = 0
        for i, _, size in sorted((r for r in rows if r[1] == path), key=lambda r: place[r[0]]):
            upto += size
            out[i] = full + (rest > 0 and upto <= rest)
    return out


@pytest.mark.parametrize(("percent", "epochs", "weights"), [(60, 2, {("a",): 5, ("a", "x"): 3}), (150, 3, {("b",): 9, ("b", "y", "s"): 0}), (100, 1, {}), (10, 4, {("a",): 0})])
def test_copies_against_a_walk_of_the_tree(spark, monkeypatch, percent, epochs, weights):
    monkeypatch.setattr(mixing, "DIGITS", (1, 2))
    rows = [(i, ("ab"[i % 3 % 2], "xyz"[i % 7 % 3], "st"[i % 5 % 2]), (i * 37) % 211 if i % 9 else 0) for i in range(400)]
    df = spark.createDataFrame([(i, *p, n) for i, p, n in rows], "doc_id long, a string, b string, c string, n_tokens long")
    got = {r.doc_id: r.copies for r in mixing.copies(df, ["a", "b", "c"], weights, percent, epochs, 3).collect()}
    assert got == plain(rows, weights, percent, epochs, 3)


def test_query_against_its_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.sql(ORACLES["op7_mixing"])
    columns = want.columns
    assert sorted(tuple(r[c] for c in columns) for r in op7_mixing(spark, sf_dir).collect()) == sorted(want.fetchall())


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "", "p", "x"), (3, "a b  c", "p", "x"), (3, "a b  c", "p", "x"), (None, "d e", None, "x"), (None, "d e", None, "x"), (6, "w " * 50_000, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, full string")
    out = mixing.mix(df, {"source": "source"}, {}, 100, 2)
    assert out.columns == df.columns
    sizes = Counter((r.doc_id or 0) for r in out.collect())
    assert sizes[0] % 2 == 0 and sizes[3] % 2 == 0 and set(sizes) <= {0, 1, 2, 3, 6}
    assert sum(len(re.findall(r"\S+", r.text or "")) for r in out.collect()) <= 50_010
    assert mixing.mix(df.limit(0), {"source": "source"}, {}).count() == 0
    assert mixing.mix(df, {"source": "source"}, {("p",): 0, ("q",): 0}).where("source in ('p', 'q')").count() == 0
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(df, {"source": "source"}, {("p",): -1})
    assert [r[0] for r in df.select(mixing.words(F.col("text"))).collect()] == [0, 0, 3, 3, 2, 2, 50_000]


def test_columns_with_the_names_of_helpers(spark):
    names = ["budget", "rest", "cap"]
    rows = spark.createDataFrame([(i, f"d{i % 2}", f"l{i % 3}", f"s{i % 5}", 10 + i) for i in range(60)], "full long, budget string, rest string, cap string, at long")
    same = rows.toDF("doc_id", "a", "b", "c", "n_tokens")
    weights = {("d0",): 3, ("d1", "l1"): 2}
    got = {r["full"]: r.copies for r in mixing.copies(rows, names, weights, 70, 2, 5, "full", "at").collect()}
    want = {r.doc_id: r.copies for r in mixing.copies(same, ["a", "b", "c"], weights, 70, 2, 5).collect()}
    assert got == want and set(want.values()) > {1}

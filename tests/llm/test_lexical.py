import heapq
import math
import re
from collections import Counter

import numpy as np

from changelens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(FOLD))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)))
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        out += [(item, rank, None if doc == math.inf else doc, -score) for rank, (score, doc) in enumerate(heapq.nsmallest(k, scored), 1)]
    return out


DOCS = [(1, "Alpha beta, beta"), (2, "alpha beta beta"), (3, None), (4, ""), (5, "!!! --- _"), (None, "alpha beta beta"), (6, "É é straße 你好"), (7, "alpha " * 5000), (-8, "gamma delta"), (2, "beta"), (9, "x_y\x7fz 12")]
ITEMS = [(10, "alpha"), (11, "BETA beta gamma"), (11, "é 你好 y 12"), (None, "delta"), (12, None), (13, ""), (14, "nowhere"), (15, "É")]


def rows(found):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc", "score")) for r in found.collect()), key=str)


def test_edges_against_plain_python(spark):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in DOCS], "doc_id long, text string, score string, n int")
    items = spark.createDataFrame([(i, t, "kept") for i, t in ITEMS], "item_id long, text string, id string")
    for k in (1, 2, 50):
        found = lexical.search(docs, items, k)
        assert rows(found) == sorted(plain(DOCS, ITEMS, k), key=str)
        assert {r.id for r in found.collect()} == {"kept"}
    assert lexical.search(docs.limit(0), items, 5).count() == lexical.search(docs, items.limit(0), 5).count() == 0


def test_blocks_of_items_and_of_triples_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = rows(lexical.search(docs, items, 7))
    assert whole == sorted(plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 7), key=str)
    monkeypatch.setattr(lexical, "BLOCK_TRIPLES", 50)
    assert rows(lexical.search(docs.repartition(5), items, 7)) == whole
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 200)
    assert rows(lexical.search(docs, items, 7)) == whole


def test_radix_order_is_stable():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000)
    keys[::3] = keys[1]
    assert (lexical.radix_order(keys, 40) == np.argsort(keys, kind="stable")).all()

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import sharding
from changelens.llm.queries import op10_sharding


def least(sizes, shards):
    """Smallest capacity over all groups in order, by trying every sum in turn with a binary search."""
    low, high = max([-(-sum(sizes) // shards), *sizes]), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("n", "bits", "hot"), [(3, 16, 0), (40, 3, 0), (500, 2, 0), (500, 4, 90_000), (3000, 16, 0)])
def test_search_finds_the_least_capacity(spark, monkeypatch, n, bits, hot):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    rng = np.random.default_rng(n + bits)
    place = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
    size = rng.integers(1, 1000, len(place))
    size[len(size) // 3] += hot
    rows = list(zip(place.tolist(), size.tolist(), strict=True))
    capacity, cuts = sharding.search(spark.createDataFrame(rows, "place long, size long"), 24)
    sizes = size.tolist()
    assert capacity == least(sizes, 24)
    shard = [sum(p >= c for c in cuts if c is not None) for p in place.tolist()]
    loads = np.bincount(shard, weights=sizes, minlength=24)
    assert loads.max() <= capacity
    if n >= 500 and not hot:
        assert loads.min() > 0.8 * sum(sizes) / 24


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_text, slots = {}, {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert by_text.setdefault(data, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = {}
    for r in rows:
        groups[docs[r.doc_id]] = groups.get(docs[r.doc_id], 0) + r.size
    place = {r.t: r.p for r in spark.createDataFrame([(t,) for t in groups], "t string").select("t", F.xxhash64("t").alias("p")).collect()}
    loads = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) <= least([groups[t] for t in sorted(groups, key=place.get)], 24)


def test_edges(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "x" * 200_000, 5), (2, "", 5), (3, "a", 5), (3, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumns({"_size": F.lit("x"), "place": F.lit("y")})
    args = (24, F.coalesce("text", F.lit("")), F.length("text"), F.col("doc_id"))
    got = sharding.assign(df, *args).collect()
    assert len(got) == 6 and len({r.shard for r in got if not r.text}) == 1 and len({(r.shard, r.slot) for r in got}) == 6
    assert sharding.assign(df.limit(0), *args).count() == 0

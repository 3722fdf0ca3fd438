import numpy as np
import pytest
import xxhash

from changelens.llm import simhash
from changelens.llm.common import components
from changelens.llm.queries import op2_simhash


def plain(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """Least index of each one's component, by comparing all with all."""
    label, values = list(range(len(prints))), np.array(prints, np.uint64)
    changed = True
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= radius) for v in values]
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min(label[j] for j in others)
            if low < label[i]:
                label[i], changed = low, True
    return label


def plain_sketch(text, words=5):
    """1024 majorities over the set of shingles, bit by bit, and the set."""
    found = (text or "").encode().lower().split()
    shingles = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    out = 0
    for k in range(simhash.PARTS):
        ones = [0] * 64
        for s in shingles:
            z = (xxhash.xxh64_intdigest(s, 42) + k * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            for b in range(64):
                ones[b] += z >> b & 1
        out |= sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) << 64 * k
    return out, shingles


def similar(texts, similarity=0.8):
    """Least index of each text's component, by the true similarity of all pairs."""
    sets = [plain_sketch(t)[1] for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i, x in enumerate(map(set, sets)) for j, y in enumerate(map(set, sets[:i])) if len(x & y) >= similarity * len(x | y)]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_similar_sets_link_and_others_do_not(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(40):
        base = rng.choice(words, rng.integers(60, 400)).tolist()
        changed, half = list(base), list(base)
        for i in rng.choice(len(base), len(base) // 60 + 1, replace=False):
            changed[i] = "other"  # about 8 of 100 shingles
        half[len(half) // 2 :] = rng.choice(words, len(half) - len(half) // 2).tolist()
        docs += [base, changed, half]
    texts = [" ".join(d) for d in docs] + ["", "", None, "two words", "two words", "two other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_similar(df).collect()}
    label = similar(texts)
    assert kept == {i for i, x in enumerate(label) if i == x}
    assert all(i in kept for i in range(0, 120, 3)) and all(i in kept for i in range(2, 120, 3))  # nothing clean goes
    assert sum(i in kept for i in range(1, 120, 3)) < 5  # a few changed short texts have less than 0.8 in common with theirs
    assert kept & set(range(120, 126)) == {120, 123, 125}


@pytest.mark.parametrize("size", [1 << 17, 25])
def test_similar_by_blocks(spark, monkeypatch, sf_dir, size):
    monkeypatch.setattr(simhash, "SKETCHES", size)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    df = spark.createDataFrame([*docs, (None, "a text without an id that is like no other one at all"), docs[3]], "doc_id long, text string")
    label = similar([t for _, t in docs])
    want = {docs[i][0] for i, x in enumerate(label) if i == x} | {None}
    got = [r.doc_id for r in simhash.keep_one_similar(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert simhash.keep_one_similar(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [plain(t) for _, t in docs]
    want = {(i, f"{p:016x}", docs[k][0]) for (i, _), p, k in zip(docs, prints, groups(prints), strict=True)}
    got = op2_simhash(spark, sf_dir).collect()
    assert len(got) == len(docs) and {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("block", [4096, 7])
def test_links_of_close_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = np.repeat(base, 12) ^ sum(np.uint64(1) << rng.integers(0, 64, 360, dtype=np.uint64) for _ in range(2))
    values = [0, 2**64 - 1, 1, *np.unique(np.concatenate([base, near])).tolist()]
    signed = np.array(sorted(values, key=lambda v: np.uint64(v).astype(np.int64)), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in signed.view(np.int64)], "fingerprint long")
    got = {r.fingerprint: r.root for r in simhash.groups(df).collect()}
    want = groups(signed)
    assert got == {int(v): int(signed.view(np.int64)[k]) for v, k in zip(signed.view(np.int64), want, strict=True)}


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(None, 5), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}


def test_edges(spark):
    long = "word " * 30000 + "end"
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "a b c", 9), (5, "A  b\tC", 9), (None, "alone in here", 9), (7, long, 9), (8, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (None, 5), (5, 5), (None, None), (7, 7), (8, 7)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.fingerprint) for r in kept.collect()) == [(0, 9), (1, 9), (5, 9), (7, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()
    assert simhash.fingerprint("é x y") == plain("é x y")

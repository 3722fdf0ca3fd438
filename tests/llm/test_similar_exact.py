"""Near duplicates against components of the true Jaccard similarity of shingle sets."""

import numpy as np
import pytest

from changelens.llm import simhash


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def first_of_each(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= similarity * len(a | b)]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return {i for i, x in enumerate(label) if i == x}


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one_similar(df).collect()}


def test_small_sets(spark):
    texts = []
    for i in range(40):
        for short, more in ((8, 1), (9, 2), (16, 3), (16, 4)):  # 4 shingles in 5, 5 in 7, 12 in 15, 12 in 16
            words = [f"w{i}.{short}.{more}.{k}" for k in range(short + more)]
            texts += [" ".join(words[:short]), " ".join(words)]
    want = first_of_each(texts)
    assert len(want) == 40 * (1 + 2 + 1 + 2)
    assert kept(spark, texts) == want


@pytest.mark.parametrize("size", [1 << 17, 60])
def test_similarities_about_the_threshold(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "SKETCHES", size)
    rng, texts = np.random.default_rng(8), []
    for i in range(60):
        base = [f"w{i}.{k}" for k in range(int(rng.integers(40, 300)))]
        texts.append(" ".join(base))
        for _ in range(3):
            cut = int(len(base) * rng.uniform(0.1, 0.35))  # a tail of other words: similarities from 0.6 to 0.9
            texts.append(" ".join([*base[: len(base) - cut // 2], *(f"x{rng.integers(1 << 40)}" for _ in range(cut // 2))]))
    assert kept(spark, texts) == first_of_each(texts)


def test_a_chain_holds_only_by_true_links(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k : k + 104]) for k in range(0, 290, 10)]  # next ones share 90 of 110 shingles
    assert kept(spark, texts) == {0} == first_of_each(texts)
    texts = [" ".join(words[k : k + 104]) for k in range(0, 290, 12)]  # 88 of 112
    assert kept(spark, texts) == set(range(len(texts))) == first_of_each(texts)

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import suffix_tree as st
from changelens.llm.queries import op9_lm_score

END = b""


def plain(train, texts):
    """The model by definition, over dictionaries: yields (tokens, known, base, score) of each text."""
    split = lambda t: [*(t or "").encode().lower().split(), END]
    counts = Counter(w for t in train for w in split(t))
    total, v = sum(counts.values()), len(counts)
    root = lambda w: (counts[w] + 1) / (total + v + 1)
    symbols = {w for w, n in counts.items() if n >= st.MIN_SYMBOL * total} | {END}
    after, seen = defaultdict(Counter), Counter()
    for t in train:
        run = [END, *split(t)]
        for size in range(1, st.DEPTH + 1):
            for i in range(len(run) - size):
                context = tuple(run[i : i + size])
                if END not in context[1:]:
                    after[context][run[i + size]] += 1
                    seen[context] += 1
    core = {c for c, n in seen.items() if n >= st.MIN_CONTEXT * total and symbols.issuperset(c)}
    rim = {c for c, n in seen.items() if c not in core and n > 1 and (len(c) == 1 or c[1:] in core)}
    states = {}

    def probability(context, w):
        for k in range(len(context)):
            if context[k:] in states:
                own, rest = states[context[k:]]
                return own[w] if w in own else rest * probability(context[k + 1 :], w)
        return root(w)

    for size, of in [*((size, core) for size in range(1, st.DEPTH + 1)), (None, rim)]:
        new = {}
        for context in of:
            n = seen[context]
            if size not in (None, len(context)):
                continue
            own = {w: (c - st.DISCOUNT) / n for w, c in after[context].items() if w in symbols and c >= max(1, st.MIN_NEXT * n)}
            if not own:
                continue
            suffix = {w: probability(context[1:], w) for w in own}
            rest, suffix_rest = max(1e-9, 1 - sum(own.values())), max(1e-9, 1 - sum(suffix.values()))
            nats = sum(p * math.log(p / suffix[w]) for w, p in own.items()) + rest * math.log(rest / suffix_rest)
            if nats >= st.MIN_NATS and nats * n >= st.MIN_EVIDENCE:
                new[context] = own, rest / suffix_rest
        states |= new
    out = []
    for t in texts:
        run = [END, *split(t)]
        score = sum(math.log10(probability(tuple(run[max(0, i - st.DEPTH) : i]), run[i])) for i in range(1, len(run)))
        out.append((len(run) - 1, sum(counts[w] > 0 for w in run[1:]), sum(math.log10(root(w)) for w in run[1:]), score))
    return out, total, {c for c in states if c in rim}, {c for c in states if c in core}


@pytest.mark.parametrize("values", [(1e-6, 5e-5, 0.01, 1 << 22, 1 << 20), (2e-4, 1e-3, 0.05, 5000, 2000), (1e-6, 2e-3, 0.01, 20_000, 1 << 20)])
def test_query_against_the_definition(spark, sf_dir, monkeypatch, values):
    for name, value in zip(("MIN_SYMBOL", "MIN_CONTEXT", "MIN_NEXT", "BUCKET", "PACKED"), values, strict=True):
        monkeypatch.setattr(st, name, value)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want, total, rim, core = plain([t for i, t in docs if not held(i)], [t for _, t in docs])
    got = {r.doc_id: r for r in op9_lm_score(spark, sf_dir).collect()}
    assert len(got) == len(docs) and rim and core and max(map(len, rim)) > 1
    for (i, _), (n, known, base, score) in zip(docs, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-6)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = [r for r in op9_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_what_repeats_is_learned_at_any_size(spark):
    """A passage of rare words that occurs three times in a large corpus is a run of states."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) for _ in range(200)]
    passage = " ".join(f"w{k}" for k in rng.integers(0, 3000, 60))
    texts += [f"{passage} {texts[i][:500]}" for i in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, passage])], "doc_id long, text string")
    train = df.where(f"doc_id < {len(texts)}").select("text")
    counts = st.checkpoint(st.word_counts(train))
    got = {r.doc_id: r for r in st.score(df, st.learn(train, counts), counts, F.col("doc_id") < len(texts)).collect()}
    assert got[len(texts)].score > got[len(texts)].base_score / 2
    want = plain(texts, [passage])[0][0]
    assert got[len(texts)].score == pytest.approx(want[3])


def test_edges(spark):
    rows = [(1, None, 0), (1, None, 0), (None, "", 0), (3, "A a b", 0), (3, "A a b", 0), (4, "zz " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    train = df.where("doc_id = 3").select("text")
    counts = st.checkpoint(st.word_counts(train))
    out = st.score(df, st.learn(train, counts), counts, F.col("doc_id") == 3).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    end, a, b, new = (math.log10(x / 12) for x in (3, 5, 3, 1))
    want = [(0, 1, 1, 8, end), (1, 1, 1, 8, end), (1, 1, 1, 8, end), (3, 4, 4, 8, 2 * a + b + end), (3, 4, 4, 8, 2 * a + b + end), (4, 50_001, 1, 8, 50_000 * new + end)]
    assert got == [(*w[:4], round(w[4], 6)) for w in want]
    named = df.select(F.concat(F.lit("id "), "doc_id").alias("name"), "text", "score")
    assert {r.name for r in st.score(named, st.learn(train, counts), counts, F.col("name") == "id 3", "name").collect()} == {None, "id 1", "id 3", "id 4"}
    none = st.checkpoint(st.word_counts(train.limit(0)))
    assert [r.base_score for r in st.score(df.where("doc_id = 3"), st.learn(train.limit(0), none), none, F.lit(False)).collect()] == [0.0, 0.0]
    assert st.score(df.limit(0), st.learn(train, counts), counts, F.lit(True)).count() == 0
    assert np.isfinite([r.score for r in out]).all()

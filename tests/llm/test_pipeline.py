from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import queries
from tests.llm.test_bpe import REFERENCE
from tests.llm.test_mixing import plain as plain_mix
from tests.llm.test_quality import plain_scores
from tests.llm.test_simhash import similar


def test_run_against_plain_python(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    train = [(r.text, labels[r.doc_id]) for r in docs if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5]
    good = sorted((r for r, s in zip(docs, plain_scores(train, [r.text for r in docs]), strict=True) if s >= 0.3), key=lambda r: r.doc_id)
    root = similar([r.text for r in good])
    kept = [r for i, r in enumerate(good) if root[i] == i]
    domain = lambda s: "crawl" if s == "src0" else "reference" if len(s) == 4 else "community"
    rows = [(r.doc_id, (domain(r.source), r.lang, r.source), len((r.text or "").encode().split())) for r in kept]
    copies = plain_mix(rows, queries.MIX_WEIGHTS, corpus_pipeline.MIX_PERCENT, queries.MIX_EPOCHS, queries.MIX_SEED)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    texts = {r.doc_id: r for r in kept}
    for r in got:
        assert r.ids == REFERENCE.encode_ordinary(texts[r.doc_id].text or "") and r.n_tokens == len(r.ids) and r.exact and r.source == texts[r.doc_id].source


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    odd = docs.limit(5).union(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() <= 2 * odd.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


CLASHING = ("__row", "_", "__key", "__doc", "__copies", "__epoch", "__level0", "__tokens", "statistics", "label", "row", "id", "ids", "exact", "_both", "n_tokens", "sketch")


def test_stages_keep_extra_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src0", 0), (7, "a", "en", "src0", 1), (7, "b", "en", "src0", 1)], docs.schema))
    extra = odd.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, sf_dir)
        assert got.columns == extra.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
        plain = Counter(r.doc_id for r in stage(spark, odd, sf_dir).collect())
        assert Counter(r.doc_id for r in rows) == plain
    last = corpus_pipeline.STAGES[-1][1](spark, extra, sf_dir)
    assert last.count() == extra.count() and last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    by_text = {r.doc_id: r for r in last.collect()}
    assert all(isinstance(r.ids, list) and r.exact for r in by_text.values())

"""Whether the pages that records cite still say what is quoted of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..session import checkpoint
from . import tokens


def evidence(records: DataFrame) -> DataFrame:
    """(id, url, text): each quotation of each record; the record's own page where none is named."""
    rows = records.select("id", "source_url", F.explode("evidence").alias("e"))
    return rows.select("id", F.coalesce("e.url", "source_url").alias("url"), F.col("e.text").alias("text"))


def check(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, status, missing, errors): missing if a page was read and lacks a quotation, error if a page can't be read.

    pages: (url, text, error). Texts are compared in their normal form; each page
    and quotation is normalised once, before they meet.
    """
    quotes = evidence(records).withColumn("wanted", normalize(F.col("text")))
    read = pages.select("url", normalize(F.col("text")).alias("page"), "error")
    found = quotes.join(read, "url", "left")
    failed = F.col("page").isNull() | (F.coalesce("error", F.lit("")) != "")
    found = found.withColumns({"failed": failed, "ok": ~failed & F.col("page").contains(F.col("wanted"))})
    status = F.when(F.bool_or(~F.col("ok") & ~F.col("failed")), "missing").when(F.bool_or("failed"), "error").otherwise("ok")
    results = found.groupBy("id").agg(
        status.alias("status"),
        F.array_sort(F.collect_set(F.when(~F.col("ok") & ~F.col("failed"), F.col("text")))).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("url")))).alias("errors"),
    )
    none = records.where(F.size(F.coalesce("evidence", F.array())) == 0).select("id", F.lit("no_evidence").alias("status"), F.array().cast("array<string>").alias("missing"), F.array().cast("array<string>").alias("errors"))
    return results.unionByName(none)


#: Wanted runs, and candidate pairs, up to which they are broadcast (two numbers each, and a pair's quotation); more are joined by a shuffle.
BROADCAST_RUNS, BROADCAST_NEAR = 500_000, 20_000


def containment(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str, word: int = 3) -> DataFrame:
    """(quote, text) pairs by containment, without an address to join on: candidates share their rarest run of words.

    A run is ``word`` words between single spaces. A quotation is contained only in
    texts that hold all its inner runs, so it's enough to look it up by one: the run
    that fewest quotations share. The texts' runs, as hashes and each once a text, meet the wanted ones where they are read, and
    only those that some quotation wants go any further. Quotations too short to have a run are
    looked for by automata. Null texts and quotations are contained in nothing and hold nothing.
    """
    quotes, texts = quotes.select(quote_key, "text").where("text is not null"), texts.select(text_key, "text").where("text is not null")
    by_run = _runs(quotes, quote_key, word, inner=True)
    shared = by_run.groupBy("run").agg(F.count("*").alias("n"))
    best = checkpoint(by_run.join(shared, "run").groupBy(quote_key).agg(F.min_by("run", F.struct("n", "run")).alias("run")))
    small = F.broadcast if best.count() <= BROADCAST_RUNS else (lambda df: df)
    near = checkpoint(_runs(texts, text_key, word).join(small(best), "run").select(text_key, quote_key).distinct().join(quotes.withColumnRenamed("text", "wanted"), quote_key))
    # the long texts stay where they are if their candidates are few
    small = F.broadcast if near.count() <= BROADCAST_NEAR else (lambda df: df)
    found = texts.join(small(near), text_key).where(F.col("text").contains(F.col("wanted"))).select(quote_key, text_key)
    short = checkpoint(quotes.where(F.size(F.split("text", " ")) < word + 2))
    distinct = short.select("text").distinct()
    blocks = 1 + distinct.count() // tokens.SCAN_BLOCK
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("text"), F.lit(blocks)) == b
        forms = [r.text for r in distinct.where(mine).collect()]  # a block's worth
        if forms:
            plain = [f for f in forms if f]
            # every text holds the empty quotation
            held = F.concat(tokens.held(F.col("text"), plain) if plain else F.array().cast("array<string>"), F.array(*[F.lit("")] * ("" in forms)).cast("array<string>"))
            hits = texts.select(text_key, F.explode(held).alias("text"))
            found = found.unionByName(hits.join(F.broadcast(short.where(mine).select(quote_key, "text")), "text").select(quote_key, text_key))
    return found.distinct()


def _runs(df: DataFrame, key: str, word: int, inner: bool = False) -> DataFrame:
    """(key, run): the hash of each run of words, once; inner: without the first and the last word, which a text may continue."""
    words = df.select(key, F.split("text", " ").alias("_words"))
    last = F.size("_words") - word + 1
    places = F.when(last >= 3, F.sequence(F.lit(2), F.greatest(last - 1, F.lit(2)))) if inner else F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
    run = lambda i: F.xxhash64(*[F.get("_words", i + (k - 1)) for k in range(word)])
    return words.select(key, F.explode(F.array_distinct(F.transform(places, run))).alias("run"))

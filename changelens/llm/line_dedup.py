"""Dropping lines that many documents share, with levelled sorted runs of line hashes.

``Runs`` counts in how many documents a line stands, batch by batch. A run is a table of
(h1, h2, docs), bucketed and sorted by the hash of a line's key, so runs are merged by merge
joins without a shuffle. A new batch is counted, anti-joins what the runs say is frequent
already (such lines needn't be counted further), and is added as a run of level 0. Two runs of one
level are compacted into one of the next, so there are never more runs than the logarithm of
the batches. ``drop_repeated`` adds a table in batches and drops the frequent lines.

Everything on this path is a DataFrame or SQL function.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys are known by
two 64-bit hashes together: two of 10^12 different keys agree with a probability of 10^-15.

Defined results: a null or empty text is one empty line. Every row is a document, also one with an id or text
that occurs before. A line that a document repeats counts once for it, and all its places go. Null ids and
any other columns are kept as they are; a column named like a result is replaced by it. An empty table gives no rows.
A text's lines needn't fit a task's memory more than once: they are handled text by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, shared_path

#: Frequent keys up to which they are broadcast (16 bytes each); more of them are merge-joined.
BROADCAST_KEYS = 500_000
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    ascii_only = F.octet_length(line) == F.char_length(line)
    folded = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.btrim(folded, F.lit(SPACE))


def hashes(key: Column, a: str = "h1", b: str = "h2") -> list[Column]:
    """Two independent hashes: the second is seeded by that of another text."""
    return [F.xxhash64(key).alias(a), F.xxhash64(F.lit("second"), key).alias(b)]


def document_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, docs): in how many rows a line of at least some code points stands."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), line_key))
    each = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= min_chars)
    return each.select(*hashes(F.col("key"))).groupBy(*HASHES).agg(F.count("*").alias("docs"))


class Runs:
    """Levelled sorted runs of line hashes in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []

    def _write(self, run: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "line-run")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        run.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("docs", "more").hint("merge"), HASHES, "full_outer")
        return both.select(*HASHES, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (h1, h2, docs); what a run has as frequent is left out."""
        for _, run in self.levels:
            counts = counts.join(run.where(F.col("docs") >= self.min_docs).hint("merge"), HASHES, "left_anti")
        level, new = 0, self._write(counts)
        while self.levels and self.levels[-1][0] == level:
            new = self._write(self._merged(self.levels.pop()[1], new))
            level += 1
        self.levels.append((level, new))

    def repeated(self) -> DataFrame:
        """(h1, h2) of the lines that stand in at least ``min_docs`` documents of all batches."""
        runs = [run for _, run in self.levels]
        while len(runs) > 1:
            low = runs.pop()
            runs.append(self._merged(runs.pop(), low))
        return runs[0].where(F.col("docs") >= self.min_docs).select(*HASHES)


def drop_lines(docs: DataFrame, repeated: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """The rows with ``text`` less its repeated lines, ``n_lines`` before and ``n_dropped``.

    Which lines go is found once for each different text (known by two hashes), from places and hashes
    alone; the texts meet the places that go in one join.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), *hashes(F.coalesce(text, F.lit("")), "t1", "t2"))
    body = F.col("row").getField(text)
    places = rows.select("t1", "t2", F.posexplode(F.transform(lines_of(body), line_key)).alias("place", "key"))
    places = places.where(F.char_length("key") >= min_chars).select("t1", "t2", "place", *hashes(F.col("key")))
    small = repeated.count() <= BROADCAST_KEYS
    found = places.join(F.broadcast(repeated) if small else repeated.hint("merge"), HASHES, "left_semi")
    gone = found.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    joined = rows.join(gone, ["t1", "t2"], "left").select("row", lines_of(body).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.coalesce(body, F.lit(""))).otherwise(F.array_join(let(F.struct("lines", "gone"), _without), "\n"))
    out = joined.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))
    others = [c for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], F.col("kept").alias(text), "n_lines", "n_dropped")


def _without(x: Column) -> Column:
    """The lines between the places that go, stretch by stretch."""

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(x["gone"], i - 1) + 1)
        stop = F.coalesce(F.get(x["gone"], i), F.size(x["lines"]))
        return F.slice(x["lines"], start + 1, stop - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), stretch))


def drop_repeated(docs: DataFrame, batch: Column, batches: int, min_docs: int, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``drop_lines`` of all that stands in at least ``min_docs`` rows. batch: each row's batch, from 0."""
    runs = Runs(docs.sparkSession, min_docs)
    for b in range(batches):
        runs.add(document_counts(docs.where(F.coalesce(batch, F.lit(0)) == b), text, min_chars))
    return drop_lines(docs, runs.repeated(), text, min_chars)

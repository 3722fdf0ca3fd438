"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of whole texts small: a worker holds one or two at a time, with what it makes of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: Rows of a few numbers that one file of a small table holds.
ROWS_OF_FILE = 200_000
#: Links up to whose number their nodes are broadcast.
BROADCAST_LINKS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; a local one only on a local master that names none (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_small(df: DataFrame, rows: int) -> DataFrame:
    """As ``checkpoint``, in as few files as hold a known number of rows."""
    return checkpoint(df.coalesce(1 + rows // ROWS_OF_FILE))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet to the shared checkpoint folder and read it from there from now on."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def take_ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+l] for every (s, l), end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(total)
    return values[at]


def offsets(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sum."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each of n nodes' component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that they reach.

    Alternates large-star and small-star steps; each is a minimum by node
    (combined before the shuffle) and a join of the links with it, so that no
    node's links ever meet in one group. Links are written to the checkpoint
    folder after each round. Null ends count as no link.
    """
    found = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        rows = found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(rows) == state or rows[0] == 0:
            return found.select(F.col("a").alias("node"), F.col("b").alias("root")).union(found.select("b", "b")).distinct()
        state = tuple(rows)
        # a broadcast spares the shuffle by node, in which a hub's links would meet; many nodes are joined by a shuffle, which adaptive execution splits
        spread = F.broadcast if rows[0] <= BROADCAST_LINKS else (lambda df: df)
        both = found.union(found.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(spread(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(spread(low), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        found = checkpoint_small(small, 2 * rows[0])  # a round never adds links between more nodes than there are


def sorted_groups(batches, *keys: str):
    """Groups of a partition that is sorted by ``keys``: dicts of numpy arrays, one group at a time.

    Holds a record batch and the group that runs on from it.
    """
    rest: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        cuts = np.flatnonzero(np.any([np.diff(columns[k]) != 0 for k in keys], axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for i, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            part = {n: v[start:end] for n, v in columns.items()}
            if i or (rest and any(rest[0][k][0] != part[k][0] for k in keys)):
                yield _joined(rest)
                rest = []
            rest.append(part)
    if rest:
        yield _joined(rest)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

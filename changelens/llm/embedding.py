"""Embedding near-duplicates within labels: collision counts over sorted projections.

``link`` compares all vectors of a label and says for each how many others it links
to, which component it is in, and whether it stays.

Method: every vector is projected on ``PROJECTIONS`` random directions. A pair
collides in a projection if one value lies in the window around the other; pairs
that collide often enough are verified by their cosine in double precision. The
window is one standard deviation of the difference at the threshold; the count is
the largest that ``RECALL`` of simulated pairs at the very threshold reach with
these directions, so closer pairs are missed even less.

Equal vectors are one to begin with. A label's vectors are dealt to blocks of about
``BLOCK``; each pair of blocks is one group of bounded size, whatever the label's
share of the rows. In a group each projection of the second block is sorted, and a
strip of the first one's sorted values meets only the stretch that its windows
reach. A group returns a row for each vector with links: their number there and
a node of a spanning forest, never the pairs. The number of block pairs grows with
the square of a label's size; that is the price of this method's exact counting.

Defined results: null labels, null, zero or non-finite vectors and those with null
components link with nothing; vectors of other lengths neither. A missing id is
never a component's id (null, if no other is there), and its row isn't kept.
Repeated rows link with each other. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forest, sorted_groups

COSINE = 0.93
PROJECTIONS, RECALL, SEED = 32, 0.999, 11
#: Vectors of a block, and of a strip that is compared at a time.
BLOCK, STRIP = 2048, 64


@lru_cache
def directions(size: int, cosine: float) -> tuple[np.ndarray, float, int]:
    """Unit directions (a column each), half the window, and the least count of collisions."""
    rng = np.random.default_rng(SEED)
    unit = rng.standard_normal((size, PROJECTIONS))
    unit /= np.linalg.norm(unit, axis=0)
    half = float(np.sqrt(2 * (1 - cosine) / size))
    apart = rng.standard_normal((20_000, size))
    apart *= np.sqrt(2 * (1 - cosine)) / np.linalg.norm(apart, axis=1, keepdims=True)
    counts = (np.abs(apart @ unit) <= half).sum(axis=1)
    return unit, half, max(1, int(np.quantile(counts, 1 - RECALL, method="lower")))


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and how often each collides with every row of b; a and b: a projection in each column."""
    order = [np.argsort(x, kind="stable") for x in b.T]
    sorted_ = [x[o] for x, o in zip(b.T, order, strict=True)]
    along = np.argsort(a[:, 0], kind="stable")  # neighbours of a strip share most of their windows
    for i in range(0, len(a), STRIP):
        rows = along[i : i + STRIP]
        counts = np.zeros((len(b), len(rows)), np.uint8)
        for p in range(a.shape[1]):
            values = a[rows, p]
            low, high = np.searchsorted(sorted_[p], [values.min() - half, values.max() + half])
            near = sorted_[p][low:high]
            counts[order[p][low:high]] += np.abs(near[:, None] - values) <= half
        yield rows, counts.T


def _pairs(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, "label", "tile"):
        every_size = np.array([len(v) for v in group["vector"]])
        for size in np.unique(every_size):
            at = np.flatnonzero(every_size == size)
            unit, half, least = directions(int(size), cosine)
            vectors = np.stack(group["vector"][at]).astype(np.float64)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            ids, copies, second = group["id"][at], group["copies"][at], group["second"][at].astype(bool)
            own = not second.any()  # a block with itself
            first, other = np.flatnonzero(~second), np.flatnonzero(second) if not own else np.arange(len(at))
            if not len(first) or not len(other):
                continue
            projected = (vectors @ unit).astype(np.float32)
            label, links = np.arange(len(at)), np.zeros(len(at), np.int64)
            for rows, counts in collisions(projected[first], projected[other], np.float32(half)):
                near = counts >= least
                columns = np.flatnonzero(near.any(axis=0))
                near = near[:, columns]
                near &= vectors[first[rows]] @ vectors[other[columns]].T >= cosine
                near[first[rows][:, None] == other[columns]] = False
                links[first[rows]] += near @ copies[other[columns]]
                if not own:
                    links[other[columns]] += near.T @ copies[first[rows]]
                x, y = np.nonzero(near)
                a, b = first[rows[x]], other[columns[y]]
                new = label[a] != label[b]
                if new.any():
                    label = forest(np.concatenate([a[new], np.arange(len(at))]), np.concatenate([b[new], label]), len(at))
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(ids[label[found]]), pa.array(links[found])], ["a", "b", "links"])


def valid(vector: Column) -> Column:
    """Whether a vector has a direction: some component isn't zero, all are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; label: an integer column."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    linked = F.col("label").isNotNull() & valid(F.col("vector"))
    hashes = [F.when(linked, h("label", "vector")).alias(n) for n, h in (("h1", F.xxhash64), ("h2", F.hash))]
    keys = checkpoint(rows.select("key", "label", *hashes))
    # equal vectors of a label are one class, with its number and least key
    classes = rows.where(linked).groupBy("label", *hashes).agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("key").alias("least"))
    classes = checkpoint(classes).withColumn("id", F.monotonically_increasing_id())
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = classes.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.least("block", "other") * (1 << 31) + F.greatest("block", "other")
    dealt = dealt.select("label", tile.alias("tile"), (F.col("block") > F.col("other")).alias("second"), "id", "copies", "vector")
    found = dealt.repartition("label", "tile").sortWithinPartitions("label", "tile").mapInArrow(lambda batches: _pairs(batches, cosine), "a long, b long, links long")
    found = checkpoint(found)
    tree = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("label", "h1", "h2", "id", "copies", "least").join(links, classes.id == links.a, "left").join(tree, classes.id == tree.node, "left")
    named = named.select("label", "h1", "h2", "least", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(first, "root").select("label", "h1", "h2", "n_links", "component_id")
    out = keys.join(of, ["label", "h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))

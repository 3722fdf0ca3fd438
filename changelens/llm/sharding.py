"""Sharding: minimax contiguous partition of ordered atomic groups.

``assign`` puts rows into shards so that rows of a group (equal group value) stay
together and the largest shard is as small as can be, and numbers the rows of
each shard without gaps.

Method: groups are in the order of a 64-bit hash of their value. A binary search
finds the smallest capacity for which cutting greedily needs no more than the
wanted number of shards. The search runs over cells of the order, at first its
65,536 sixteen-bit prefixes: taking a cell of several groups as fluid and as solid
gives a lower and an upper bound of the capacity and of each cut; only cells
that a cut may fall into are opened (by eight more bits) until those hold one group.
So the result is that of the search over all single groups, while the driver sees
a bounded number of sums whatever the data. At that capacity the cuts go as
near to even shares as the rest allows, so that one huge group doesn't leave
shards empty.

Defined results: a null group value is a group of its own, null sizes count 0;
values with equal hashes share a group; with fewer groups than shards the last
shards are empty. Columns of the input stay, but for ``shard`` and ``slot``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

FIRST_BITS, MORE_BITS = 16, 8


@dataclass
class Cells:
    """Stretches of the order, ascending: first place, bits that they share, bytes, groups."""

    start: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    def opened(self, at: np.ndarray, inner: Cells) -> Cells:
        keep = np.ones(len(self.start), bool)
        keep[at] = False
        parts = [np.concatenate([getattr(self, n)[keep], getattr(inner, n)]) for n in ("start", "bits", "size", "groups")]
        order = np.argsort(parts[0], kind="stable")
        return Cells(*(p[order] for p in parts))


def _ends(total: np.ndarray, capacity: int, shards: int, single: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """Greedy cuts in bytes, and whether they suffice. single: cells that can't be divided; None: none can."""
    cuts, at = [], 0
    for _ in range(shards):
        reach = at + capacity
        i = int(np.searchsorted(total, reach, "right")) - 1
        end = int(total[i])
        if single is not None and i < len(single) and not single[i] and end < reach:
            end = reach  # a fluid cell gives what fits
        at = max(at, min(end, int(total[-1])))
        cuts.append(at)
    return np.array(cuts), at >= total[-1]


def _least(total: np.ndarray, low: int, high: int, shards: int, single: np.ndarray | None) -> int:
    while low < high:
        mid = (low + high) // 2
        if _ends(total, mid, shards, single)[1]:
            high = mid
        else:
            low = mid + 1
    return low


def _cells(groups: DataFrame, bits: int) -> Cells:
    """Sums by the order's first bits; ``groups`` has (place, size)."""
    start = F.shiftleft(F.shiftright("place", 64 - bits), 64 - bits) if bits < 64 else F.col("place")
    rows = groups.groupBy(start.alias("start")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).orderBy("start").toArrow()
    start, size, n = (rows.column(c).to_numpy() for c in ("start", "size", "groups"))
    return Cells(start, np.full(len(start), bits), size, n)


def search(groups: DataFrame, shards: int) -> tuple[int, list[int | None]]:
    """The least capacity, and the first place of each shard after the first (None: it is empty). groups: distinct (place, size)."""
    cells = _cells(groups, FIRST_BITS)
    if not len(cells.start):
        return 0, [None] * (shards - 1)
    while True:
        total = np.concatenate([[0], np.cumsum(cells.size)])
        single = (cells.groups == 1) | (cells.bits >= 64)
        least = max(-(-int(total[-1]) // shards), int(cells.size[single].max(initial=0)))
        low = _least(total, least, int(total[-1]), shards, single)
        high = _least(total, max(low, int(cells.size.max())), int(total[-1]), shards, None)
        first, last = _ends(total, low, shards, None)[0], _ends(total, high, shards, single)[0]
        touched = np.zeros(len(single), bool)
        for a, b in zip(np.searchsorted(total, first, "right") - 1, np.searchsorted(total, last, "left"), strict=True):
            touched[max(0, a) : b + 1] = True
        if low == high and (cells.size.max() <= low):
            break  # solid cells reach the bound
        touched = np.flatnonzero((touched | (cells.size > low)) & ~single)
        if not len(touched):
            break
        bits = int(cells.bits[touched].min())
        touched = touched[cells.bits[touched] == bits]
        begin = cells.start[touched]
        prefix = F.shiftright("place", 64 - bits)
        wanted = groups.sparkSession.createDataFrame([(int(x) >> (64 - bits),) for x in begin], "prefix long")
        inner = _cells(groups.withColumn("prefix", prefix).join(F.broadcast(wanted), "prefix", "left_semi"), min(64, bits + MORE_BITS))
        cells = cells.opened(touched, inner)
    capacity = _least(total, low, high, shards, None)
    return capacity, _even_cuts(cells, total, capacity, shards)


def _even_cuts(cells: Cells, total: np.ndarray, capacity: int, shards: int) -> list[int | None]:
    n = len(cells.start)
    reach = np.searchsorted(total, total[:-1] + capacity, "right") - 1  # the cell after the furthest end
    need = np.zeros(n + 1, np.int64)  # shards for the rest from a cell on
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]]
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        if at < n:
            target = total[at] + (total[-1] - total[at]) / (left + 1)
            end = int(np.searchsorted(total, target))
            if end > at + 1 and target - total[end - 1] < total[min(end, n)] - target:
                end -= 1
            enough = int(np.searchsorted(-need, -left))  # the first cell from which the rest fits
            at = min(max(end, enough, at + 1), int(reach[at]))
        cuts.append(int(cells.start[at]) if at < n else None)
    return cuts


def assign(df: DataFrame, shards: int, group: Column, size: Column, order: Column) -> DataFrame:
    """Add ``shard`` and ``slot``; ``order`` ranks the rows of a group in their shard."""
    rows = checkpoint(df.withColumns({"__place": F.xxhash64(group), "__size": F.coalesce(size.cast("long"), F.lit(0)), "__order": order}))
    groups = checkpoint(rows.groupBy(F.col("__place").alias("place")).agg(F.sum("__size").alias("size")))
    _, cuts = search(groups, shards)
    shard = sum([(F.col("__place") >= c).cast("int") for c in cuts if c is not None], F.lit(0))
    # rows in their order over many partitions; a group of any size is split by the order, copies of a row by their number
    rows = rows.withColumns({"shard": shard.cast("int"), "__copy": F.monotonically_increasing_id()})
    keys = ["shard", "__place", "__order", "__copy"]
    rows = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("shard", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))  # a row for each partition and shard in it
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("shard", "__part", (before - F.col("__first")).alias("__shift"))
    out = rows.join(parts, ["shard", "__part"]).withColumn("slot", F.col("__at") + F.col("__shift"))
    return out.select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")

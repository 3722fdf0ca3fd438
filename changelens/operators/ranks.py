"""Places and running sums over a whole table in an order, without ever putting it into one task.

The rows are dealt out by ranges of the order and numbered in their part; the parts' counts and sums, a row
for each part, say where each part begins. The dealt rows are written to the checkpoint folder,
as dealing them out again might cut the ranges elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Spark's growing ids have a row's number in its part in so many low bits, and the part above.
PART_BITS = 33


def placed(df: DataFrame, order: Sequence[Column], out: str = "place", size: Column | None = None, total: str = "upto") -> DataFrame:
    """df with each row's place (from 1) in an order, and with ``size`` the sum of sizes up to it, itself included.

    The order should tell all rows apart; equal ones stand in any order, but each has its place. Null sizes count as 0.
    Columns named like a result are replaced.
    """
    mine = "_" * (1 + max(map(len, df.columns)))  # longer than any name, so no other column's
    sized = df.withColumn(mine, F.lit(0).cast("long") if size is None else F.coalesce(size, F.lit(0)).cast("long"))
    dealt = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    id_ = F.monotonically_increasing_id()
    dealt = checkpoint(dealt.select(F.struct(*df.columns).alias("row"), F.col(mine).alias("size"), id_.alias("id")))
    dealt = dealt.select("row", "size", F.shiftright("id", PART_BITS).alias("part"), F.col("id").bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are parts
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    begins = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "s")])
    if size is not None:
        dealt = dealt.withColumn("sum", F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    found = dealt.join(F.broadcast(begins), "part")
    results = {out: F.col("n") + F.col("at") + 1} | ({} if size is None else {total: F.col("s") + F.col("sum")})
    replaced = [name.lower() for name in results]
    return found.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in replaced], *[c.alias(name) for name, c in results.items()])


def document(head: Sequence[str], parts: Sequence[DataFrame], between: Sequence[str], tail: Sequence[str]) -> DataFrame:
    """(place, line): the lines of a document that holds lists; each part (place from 1, line) is a list, whose lines but the last get a comma.

    between: lines that stand between two parts. Written in the order of place, the lines are the document.
    """
    spark = parts[0].sparkSession
    rows, out, at = [(i, x) for i, x in enumerate(head, 1)], None, len(head)
    for i, part in enumerate(parts):
        n = part.count()
        listed = part.select((F.col("place") + at).alias("place"), F.concat("line", F.when(F.col("place") < n, ",").otherwise("")).alias("line"))
        out = listed if out is None else out.unionByName(listed)
        after = between if i + 1 < len(parts) else tail
        rows += [(at + n + k, x) for k, x in enumerate(after, 1)]
        at += n + len(after)
    return out.unionByName(spark.createDataFrame(rows, "place long, line string"))


def cut(df: DataFrame, order: Sequence[Column], limit: int, line: str = "line") -> DataFrame:
    """(place, line): the lines in an order, each with its line end, up to ``limit`` characters in all; the line in which the limit falls is cut there."""
    found = placed(df, order, size=F.char_length(line) + 1)
    start = F.col("upto") - F.char_length(line) - 1
    return found.where(start < limit).select("place", F.substr(line, F.lit(1), F.least(F.char_length(line), (F.lit(limit) - start).cast("int"))).alias("line"))

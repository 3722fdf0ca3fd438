"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

``plan`` spreads a token budget over a tree of path columns (domain, language,
source, ...), ``copies`` says how often each row is taken, ``mix`` returns the rows
taken, as often.

Method: a node's budget goes to its children in proportion to their weights, but no
child gets more than its leaves can give (their tokens times ``max_epochs``); what a
child can't use goes to its siblings by weight, and only what all of them can't use
falls back to the ancestors' other children. A leaf's budget is whole epochs of its
rows and then the longest prefix of one more epoch that fits. An epoch's order is
that of md5(seed:epoch:id); its cut is found by summing tokens over prefixes of the
digest, three hex digits at a time, so that only the last few rows of a leaf are
ever sorted in one place.

Only leaves (paths) are gathered; their plan is broadcast up to ``MAX_LEAVES`` rows
and joined by a shuffle beyond that.

Defined results: null path values are the empty string, null texts have no tokens,
rows without tokens go with the prefix that they fall in, rows with the same id go
together, null ids are the empty string; nodes with weight 0 get nothing. Columns of
the input stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_small

MAX_LEAVES = 10_000
#: Hex digits of the digest after which the cut is narrowed down.
DIGITS = (3, 6)
BIG = "decimal(38,0)"


def words(text: Column) -> Column:
    """Words between ASCII white space, as the count of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight(path: Sequence[Column], weights: dict[tuple[str, ...], int], default: int = 1) -> Column:
    """The weight of the node that a path leads to; unnamed nodes have the default."""
    named = {"\x1f".join(k): w for k, w in weights.items() if len(k) == len(path)}
    if not named:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.concat_ws("\x1f", *path)], F.lit(default))


def _spread(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``given``: the parents' ``budget`` dealt to children with ``cap`` and ``weight``."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap").cast("double") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG).alias("_cap"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).cast(BIG).alias("_weight"),
        F.sum("weight").over(by).cast(BIG).alias("_all"),
    )
    full = F.expr("cap * (_all - _weight) <= (budget - _cap) * weight")  # those that are full come first
    nodes = nodes.withColumn("_open", F.max(F.when(full, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    nodes = nodes.withColumn("_cap", F.coalesce(F.sum(F.when(~F.col("_open"), F.col("cap"))).over(by), F.lit(0)).cast(BIG))
    nodes = nodes.withColumn("_weight", F.coalesce(F.sum(F.when(~F.col("_open"), F.col("weight"))).over(by), F.lit(0)).cast(BIG))
    given = F.when(F.col("_open"), F.expr("((budget - _cap) * weight) div (_all - _weight)").cast(BIG)).otherwise(F.col("cap"))
    return nodes.withColumn("given", given).drop("_cap", "_weight", "_all", "_open")


def plan(rows: DataFrame, path: Sequence[str], weights: dict[tuple[str, ...], int], percent: int = 100, max_epochs: int = 4, tokens: str = "n_tokens") -> DataFrame:
    """Each leaf's budget: path, tokens, budget, full (whole epochs) and rest (tokens of one more).

    The budget of the root is ``percent`` of all tokens.
    """
    path = list(path)
    if min(weights.values(), default=1) < 0 or max_epochs < 1:
        raise ValueError("weights must not be negative, and max_epochs at least 1")
    leaves = rows.groupBy(*path).agg(F.sum(tokens).cast(BIG).alias("tokens"))
    for i in range(len(path)):
        leaves = leaves.withColumn(f"w{i}", weight([F.col(c) for c in path[: i + 1]], weights).cast(BIG))
    usable = F.expr(" and ".join(f"w{i} > 0" for i in range(len(path))))
    leaves = checkpoint_small(leaves.withColumn("cap", F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast(BIG)), MAX_LEAVES)
    rooted = leaves.withColumn("_root", F.lit(0))
    nodes = rooted.groupBy("_root").agg(F.expr(f"sum(tokens) * {int(percent)} div 100").cast(BIG).alias("budget"))
    for i in range(len(path)):
        above = ["_root", *path[:i]]
        level = rooted.where(f"w{i} > 0").groupBy(*above, path[i]).agg(F.sum("cap").cast(BIG).alias("cap"), F.max(f"w{i}").alias("weight"))
        nodes = _spread(level.join(nodes, above), above, path[i]).select(*above, path[i], F.least("given", "cap").alias("budget"))
    nodes = nodes.drop("_root")
    out = leaves.select(*path, "tokens").join(nodes, path, "left").withColumn("budget", F.coalesce("budget", F.lit(0)).cast(BIG))
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long")
    out = out.withColumn("full", full)
    return out.withColumn("rest", F.expr("cast(budget - full * tokens as bigint)"))


def _order(seed: int, key: Column, epoch: Column) -> Column:
    id_ = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), id_)), F.lit(":"), id_)


def _join(rows: DataFrame, leaves: DataFrame, path: list[str]) -> DataFrame:
    return rows.join(F.broadcast(leaves) if leaves.count() <= MAX_LEAVES else leaves, path)


def cuts(rows: DataFrame, leaves: DataFrame, path: Sequence[str], seed: int, key: str, tokens: str = "n_tokens") -> DataFrame:
    """The plan with ``cut``: the last place in the order of its last epoch that a leaf takes, null for none."""
    path = list(path)
    ordered = _join(rows.select(*path, key, tokens), leaves.select(*path, "full", "rest").where("rest > 0"), path).select(*path, _order(seed, F.col(key), F.col("full")).alias("place"), tokens, "rest")
    ends = None
    for digits in (*DIGITS, None):
        near = ordered
        if ends is not None:  # only rows with the digits at which the sum passes the budget
            near = _join(ordered, ends, path).where(F.substring("place", 1, last) == F.col("at")).withColumn("rest", F.col("left")).drop("at", "left", "below")
        else:
            near = near.drop("below")
        step = F.col("place") if digits is None else F.substring("place", 1, digits)
        sums = near.groupBy(*path, step.alias("step")).agg(F.sum(tokens).alias("n"), F.max("rest").alias("rest"))
        sums = sums.withColumn("sum", F.sum("n").over(Window.partitionBy(*path).orderBy("step")))
        passed = sums.groupBy(*path).agg(
            F.min(F.when(F.col("sum") > F.col("rest"), F.col("step"))).alias("at"),
            F.max(F.when(F.col("sum") <= F.col("rest"), F.col("step"))).alias("below"),
            (F.max("rest") - F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.lit(0))).alias("left"),
        )
        if ends is not None:
            passed = passed.withColumnRenamed("below", "lower").join(ends.select(*path, "below"), path).withColumn("below", F.coalesce("lower", "below")).drop("lower")
        ends, last = checkpoint_small(passed, leaves.count()), digits
    # "~" is after every digit and id: a step taken whole, or all of an epoch
    cut = F.when(F.length("below") > 32, F.col("below")).otherwise(F.concat("below", F.lit("~")))
    return checkpoint_small(leaves.join(ends.select(*path, "below"), path, "left").withColumn("cut", cut).drop("below"), leaves.count())


def copies(rows: DataFrame, path: Sequence[str], weights: dict[tuple[str, ...], int], percent: int, max_epochs: int, seed: int, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """``rows`` (read twice: best written before) with ``copies``: how often each is taken."""
    inner = [f"__level{i}" for i in range(len(path))]  # names that no helper column has
    wide = rows.withColumns({n: F.col(c) for n, c in zip([*inner, "__key", "__tokens"], [*path, key, tokens], strict=True)})
    small = wide.select(*inner, "__key", "__tokens")
    leaves = checkpoint_small(plan(small, inner, weights, percent, max_epochs, "__tokens"), MAX_LEAVES)
    return take(wide, cuts(small, leaves, inner, seed, "__key", "__tokens"), inner, seed, "__key", "copies").drop(*inner, "__key", "__tokens")


def take(rows: DataFrame, leaves: DataFrame, path: Sequence[str], seed: int, key: str, out: str) -> DataFrame:
    named = leaves.select(*path, F.col("full").alias("__full"), F.col("cut").alias("__cut"))
    extra = F.when(_order(seed, F.col(key), F.col("__full")) <= F.col("__cut"), 1).otherwise(0)
    return _join(rows, named, list(path)).withColumn(out, (F.col("__full") + F.coalesce(extra, F.lit(0))).cast("int")).drop("__full", "__cut")


def mix(df: DataFrame, path: dict[str, str], weights: dict[tuple[str, ...], int], percent: int = 100, max_epochs: int = 4, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` with their columns, each as often as it is taken. path: SQL for each level of the tree."""
    named = {f"__level{i}": F.coalesce(F.expr(c).cast("string"), F.lit("")) for i, c in enumerate(path.values())}
    rows = checkpoint(df.select(F.col(key).alias("__key"), *[c.alias(n) for n, c in named.items()], words(F.col(text)).alias("__tokens")))
    leaves = cuts(rows, checkpoint_small(plan(rows, [*named], weights, percent, max_epochs, "__tokens"), MAX_LEAVES), [*named], seed, "__key", "__tokens")
    # whole rows travel as one column, so none of theirs is taken for one of these
    whole = df.select(F.struct(*df.columns).alias("__doc"), *[c.alias(n) for n, c in named.items()], F.col(key).alias("__key"))
    out = take(whole, leaves, [*named], seed, "__key", "__copies").where("__copies > 0")
    return out.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")

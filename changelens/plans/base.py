"""Tables as the roles that the operators know, in Spark and in SQL.

Orders are change records (priority is severity, status kind, the customer's nation
the vendor), line items the parameters of tools (parts) before and after a day,
events observations of a user's state, documents and pages texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SEVERITIES

Query = Callable[[SparkSession, str], DataFrame]
TODAY = "1998-06-15"


class Catalog:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow rows of which a task makes texts, at most.
SPREAD_ROWS = 100_000


def parts(df: DataFrame, rows: int) -> int:
    """To how many parts so many narrow rows are dealt out: to all cores, and to more as there are more rows, so that a task's share has a bound."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS))


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Narrow rows of which a query makes whole texts, dealt out over all cores: on disk they are a file or two, which few tasks would read.

    rows: how many there are about, if counting ``df`` is dear; a table's rows are counted from its files' footers.
    """
    return df.repartition(parts(df, df.count() if rows is None else rows), *keys)


def severity_of(priority: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.substring(priority, 1, 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as change records."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    day = F.col("o_orderdate").cast("date")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("n_name").alias("vendor"),
        F.when(F.col("o_orderstatus") == "F", "model").when(F.col("o_orderstatus") == "O", "rest").otherwise("sdk").alias("kind"),
        severity_of(F.col("o_orderpriority")).alias("severity"),
        day.alias("effective"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 40)).alias("verified_on"),
        F.col("o_orderkey").alias("load_ordinal"),
        F.col("o_custkey").alias("customer"),
        F.floor(F.col("o_totalprice")).cast("long").alias("price"),
    )


#: The same in SQL: begin a query with it.
RECORDS_SQL = """
WITH r AS (SELECT o_orderkey AS id, n_name AS vendor, CASE o_orderstatus WHEN 'F' THEN 'model' WHEN 'O' THEN 'rest' ELSE 'sdk' END AS kind,
  CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS rank, ['breaking', 'silent', 'deprecation', 'additive', 'info'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS severity,
  CAST(o_orderdate AS DATE) AS effective, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 40 END AS verified_on, o_custkey AS customer, CAST(floor(o_totalprice) AS BIGINT) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

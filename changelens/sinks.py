"""Where results go: exports as text, and tables that outlive a run.

Tables are Parquet folders. An update writes the next version beside the last one
and then names it in ``current``, so that a run that dies leaves the last version.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.feed import feed_order


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version; None before the first."""
    fs, mark, _ = _fs(spark, f"{path}/current")
    if not fs.exists(mark):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current').head()[0]}")


def write_table(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs, mark, jvm = _fs(spark, f"{path}/current")
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/.current-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(name.encode()))
    out.close()
    # readers see the old name or the new one, never a file that is being written
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, mark, how)


def insert_absent(df: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Add rows whose key the table lacks; returns what was added."""
    old = read_table(df.sparkSession, path)
    new = df.dropDuplicates([*key])
    if old is not None:
        new = new.join(old.select(*key), [*key], "left_anti")
    write_table(new if old is None else old.unionByName(new), path)
    now = read_table(df.sparkSession, path)
    return now if old is None else now.join(old.select(*key), [*key], "left_anti")


def upsert(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Put rows in the place of those with their key."""
    old = read_table(df.sparkSession, path)
    write_table(df if old is None else old.join(df.select(*key), [*key], "left_anti").unionByName(df), path)


def mark_seen(keys: DataFrame, path: str) -> None:
    """The union of what was seen before and now."""
    insert_absent(keys, path, keys.columns)


def by_vendor(records: DataFrame, path: str) -> None:
    """A folder for each vendor, its records in the site's order."""
    records.repartition("vendor").sortWithinPartitions("vendor", *feed_order(tie=["id"])).write.partitionBy("vendor").mode("overwrite").json(path)


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def sitemap(pages: DataFrame) -> DataFrame:
    """One ``url`` element for each (loc, lastmod)."""
    when = F.when(F.col("lastmod").isNull(), "").otherwise(F.concat(F.lit("<lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod>")))
    return pages.select(F.concat(F.lit("<url><loc>"), escaped(F.col("loc")), F.lit("</loc>"), when, F.lit("</url>")).alias("element"))


def atom(records: DataFrame, home: str) -> DataFrame:
    """One ``entry`` element for each record, with its vendor."""
    link = F.concat(F.lit(f"{home}/"), F.col("id").cast("string"), F.lit(".html"))
    parts = [
        F.lit("<entry><id>"), escaped(link), F.lit("</id><title>"), escaped(F.coalesce("summary", F.lit(""))), F.lit("</title><updated>"), F.date_format("effective", "yyyy-MM-dd'T'00:00:00'Z'"),
        F.lit('</updated><link href="'), escaped(link), F.lit('"/></entry>'),
    ]
    return records.select("id", "vendor", F.concat(*parts).alias("element"))


def markdown(counts: DataFrame, sites: DataFrame) -> DataFrame:
    """A block of a report for each record: its heading, counts and sites."""
    line = F.concat(F.lit("- `"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("` "), F.replace("snippet", F.lit("|"), F.lit("\\|")))
    listed = sites.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("text")))), lambda x: x.text), "\n").alias("lines"))
    head = F.concat(F.lit("### "), F.col("summary"), F.lit("\n"), F.col("severity"), F.lit(", "), F.date_format("effective", "MMM d, yyyy"), F.lit(": "), F.col("in_code").cast("string"), F.lit(" in code, "), F.col("listed").cast("string"), F.lit(" listed, "), F.col("in_test").cast("string"), F.lit(" in tests\n"))
    return counts.join(listed, "record_id", "left").select("record_id", F.concat(head, F.coalesce("lines", F.lit(""))).alias("block"))


def brief(records: DataFrame, sites: DataFrame) -> DataFrame:
    """What is to be done for each record: why, how, where."""
    where = sites.groupBy("record_id").agg(F.array_sort(F.collect_set(F.concat("file", F.lit(":"), F.col("line").cast("string")))).alias("where"))
    rows = records.join(where, records.id == where.record_id)
    text = F.concat_ws("\n", F.concat(F.lit("# "), "summary"), "detail", F.concat(F.lit("Source: "), "source_url"), F.concat(F.lit("Fix: "), "fix_hint"), F.concat(F.lit("Sites:\n- "), F.array_join("where", "\n- ")))
    return rows.select("id", text.alias("brief"))


def gate(rows: DataFrame, bad: Column) -> int:
    """1 if any row is bad, else 0: for a job's exit code."""
    return int(bool(rows.agg(F.bool_or(bad)).head()[0]))

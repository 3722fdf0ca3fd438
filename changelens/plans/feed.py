"""Queries on change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import id_slug, vendor_slug
from ..operators import extract, feed, history, ranks
from ..schemas import rank
from .base import RECORDS_SQL, TODAY, Catalog, records, table

CATALOG = Catalog()
query = CATALOG.query
DAY = f"DATE '{TODAY}'"


@query(RECORDS_SQL + "SELECT severity, count(*)::BIGINT AS n FROM r GROUP BY severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.severity_counts(records(spark, sf_dir))


@query(RECORDS_SQL + "SELECT vendor, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, lower(vendor), vendor)::INTEGER AS place FROM r GROUP BY vendor")
def vendor_counts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.vendor_counts(records(spark, sf_dir))


@query(RECORDS_SQL + "SELECT what, n, n || ' ' || what || CASE WHEN n = 1 THEN '' ELSE 's' END AS label FROM (SELECT CASE WHEN kind = 'model' AND severity = 'breaking' THEN 'retirement' ELSE kind END AS what, count(*)::BIGINT AS n FROM r GROUP BY ALL)")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.kind_counts(records(spark, sf_dir))


@query(RECORDS_SQL + f"SELECT id, vendor, severity, effective FROM r WHERE effective BETWEEN {DAY} AND {DAY} + 180 ORDER BY effective, rank, id LIMIT 50")
def upcoming_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.upcoming(records(spark, sf_dir), TODAY, 180, limit=50).select("id", "vendor", "severity", "effective")


@query(RECORDS_SQL + f"SELECT id, vendor, effective FROM r WHERE kind = 'model' AND severity = 'breaking' AND effective <= {DAY}")
def retired_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.retired(records(spark, sf_dir), TODAY).select("id", "vendor", "effective")


@query(RECORDS_SQL + f"SELECT id, effective, severity FROM r WHERE effective >= {DAY} ORDER BY effective, rank, id LIMIT 5")
def next_five_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.next_dates(records(spark, sf_dir), TODAY).select("id", "effective", "severity")


@query(RECORDS_SQL + "SELECT CAST(date_trunc('month', effective) AS DATE) AS month, count(*)::BIGINT AS n, strftime(date_trunc('month', effective), '%B %Y') AS name FROM r GROUP BY ALL")
def by_month_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.by_month(records(spark, sf_dir))


@query(RECORDS_SQL + f"SELECT CASE WHEN effective > {DAY} THEN 'coming up' ELSE 'in effect' END AS phase, severity, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def phase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy(feed.phase(F.col("effective"), TODAY).alias("phase"), "severity").agg(F.count("*").alias("n"))


_LEAD = f"row_number() OVER (PARTITION BY customer ORDER BY effective > {DAY} DESC, CASE WHEN effective > {DAY} THEN effective END ASC, CASE WHEN effective > {DAY} THEN id END ASC, effective DESC, id DESC)"


@query(RECORDS_SQL + f"SELECT customer, id, effective, severity FROM (SELECT *, {_LEAD} AS place FROM r) WHERE place = 1")
def lead_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.lead(records(spark, sf_dir), ["customer"], TODAY).select("customer", "id", "effective", "severity")


@query(RECORDS_SQL + f"SELECT vendor, id, effective, severity FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY effective, id) AS place FROM r WHERE effective > {DAY}) WHERE place = 1")
def next_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.next_by_vendor(records(spark, sf_dir), TODAY)


@query(RECORDS_SQL + f"SELECT vendor, max(greatest(coalesce(verified_on, effective), CASE WHEN effective <= {DAY} THEN effective END)) AS last_modified FROM r GROUP BY vendor")
def lastmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.last_modified(records(spark, sf_dir), ["vendor"], TODAY)


@query(RECORDS_SQL + ", c AS (SELECT vendor, severity, rank, count(*) AS n FROM r GROUP BY ALL) SELECT vendor, string_agg(n || ' ' || severity, ', ' ORDER BY rank) AS description FROM c GROUP BY vendor")
def vendor_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = records(spark, sf_dir).groupBy("vendor", "severity").agg(F.count("*").alias("n"))
    part = F.struct(rank(F.col("severity")).alias("rank"), F.concat_ws(" ", F.col("n").cast("string"), "severity").alias("text"))
    return counts.groupBy("vendor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.text), ", ").alias("description"))


@query(RECORDS_SQL + "SELECT id, row_number() OVER (ORDER BY effective DESC, rank DESC, id)::INTEGER AS export_place, row_number() OVER (ORDER BY effective DESC, rank, id)::INTEGER AS site_place FROM r")
def feed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's order and the site's, side by side."""
    rows = records(spark, sf_dir).select("id", "effective", "severity")
    export = ranks.placed(rows, feed.export_order(["id"]), "export_place").select("id", F.col("export_place").cast("int"))
    site = ranks.placed(rows, feed.feed_order(tie=["id"]), "site_place").select("id", F.col("site_place").cast("int"))
    return export.join(site, "id")


@query(RECORDS_SQL + """, l AS (SELECT rank, effective, id, 'order ' || id || ' is ' || severity || ' for ' || vendor AS line FROM r),
s AS (SELECT row_number() OVER w AS place, line, sum(length(line) + 1) OVER w AS upto, length(line) + 1 AS n FROM l WINDOW w AS (ORDER BY effective DESC, rank, id))
SELECT place::BIGINT AS place, left(line, least(length(line), 200000 - (upto - n))::INTEGER) AS line FROM s WHERE upto - n < 200000""")
def lines_to_a_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each change in the site's order, as far as 200,000 characters go."""
    rows = records(spark, sf_dir)
    line = F.concat(F.lit("order "), F.col("id").cast("string"), F.lit(" is "), "severity", F.lit(" for "), "vendor")
    return ranks.cut(rows.select("effective", "severity", "id", line.alias("line")), feed.feed_order(tie=["id"]), 200_000)


@query(RECORDS_SQL + """, p AS (SELECT *, row_number() OVER (ORDER BY effective DESC, rank, id) AS i, count(*) OVER () AS n FROM r)
SELECT (i + 1)::BIGINT AS place, to_json({'id': id::VARCHAR, 'url': 'https://x/' || id || '.html', 'title': severity, 'content_text': kind, 'date': strftime(effective, '%Y-%m-%d'), 'tags': [vendor, severity, kind]})::VARCHAR || CASE WHEN i < n THEN ',' ELSE '' END AS line FROM p
UNION ALL SELECT 1, '{"version":"https://jsonfeed.org/version/1.1","title":"All","home_page_url":"https://x","items":[' UNION ALL SELECT count(*) + 2, ']}' FROM r""")
def feed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes as the lines of one JSON feed, in the site's order."""
    rows = records(spark, sf_dir).withColumns({"id": F.lpad(F.col("id").cast("string"), 12, "0"), "summary": F.col("severity"), "detail": F.col("kind")})
    found = feed.json_feed(rows, "All", "https://x")
    return found.withColumn("line", F.regexp_replace("line", '(?<=\"id\":\"|https://x/)0+(?=[0-9])', ""))


@query("SELECT p_partkey AS id, p_name AS summary, p_brand AS vendor FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') ORDER BY p_size DESC, p_partkey LIMIT 50")
def search_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("summary"), F.col("p_brand").alias("vendor"), F.array("p_type").alias("signatures"), F.col("p_size").alias("effective"), F.lit("breaking").alias("severity")
    )
    return feed.search(parts, "RING", limit=90).select("id", "summary", "vendor")


@query("SELECT p_name AS name, p_brand AS brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id_slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS vendor_slug, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return names.select("name", "brand", id_slug(F.col("name")).alias("id_slug"), vendor_slug(F.col("brand")).alias("vendor_slug"), "n")


@query("""
WITH x AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS signature FROM part)
SELECT slug, list_transform(list_sort(list(DISTINCT {'a': lower(signature), 'b': lower(signature) <> signature, 'c': signature})), lambda s: s.c) AS spellings, count(DISTINCT id)::INTEGER AS records FROM x GROUP BY slug
""")
def identifier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(TODAY).cast("date").alias("effective"), F.array(spelled).alias("signatures"))
    return feed.identifiers(parts, id_slug(F.col("signature"))).select("slug", "spellings", F.size("records").alias("records"))


@query(RECORDS_SQL + ", c AS (SELECT DISTINCT customer, price // 1000 AS url FROM r) SELECT url, count(*)::BIGINT AS cited FROM c GROUP BY url HAVING count(*) > 2")
def index_page_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that several records cite (here: price bands of customers)."""
    return feed.index_pages(records(spark, sf_dir).select(F.col("customer").alias("id"), F.expr("price div 1000").alias("url")))


@query("SELECT d.source, count(*)::BIGINT AS published FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) GROUP BY d.source")
def published_not_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.lit(True).alias("verified"), F.lit(False).alias("illustrative"))
    failed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "missing").otherwise("ok").alias("status"))
    return feed.published(docs, failed).groupBy("source").agg(F.count("*").alias("published"))


@query(RECORDS_SQL + """
, b AS (SELECT *, row_number() OVER (PARTITION BY vendor, customer, effective ORDER BY verified_on IS NULL, id) AS place FROM r)
SELECT vendor, customer, effective, id FROM b WHERE place = 1
""")
def dedupe_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each vendor, customer and day: a verified one if there is one."""
    best = F.min_by("id", F.struct(F.col("verified_on").isNull(), "id"))
    return records(spark, sf_dir).groupBy("vendor", "customer", "effective").agg(best.alias("id"))


@query(RECORDS_SQL + f"""
, d AS (SELECT vendor, effective AS shutdown, CAST(NULL AS VARCHAR) AS section, list_sort(list(DISTINCT 'order-' || id)) AS models FROM r WHERE kind = 'model' GROUP BY ALL)
SELECT vendor, shutdown, array_to_string(models[1:4], ', ') || CASE WHEN len(models) > 4 THEN ' and ' || (len(models) - 4) || ' more' ELSE '' END AS title,
  CASE WHEN shutdown - {DAY} <= 180 THEN 'breaking' ELSE 'deprecation' END AS severity, len(models)::INTEGER AS n FROM d
""")
def group_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = records(spark, sf_dir).where("kind = 'model'").select(
        "vendor", F.col("effective").alias("shutdown"), F.lit(None).cast("string").alias("section"), F.concat(F.lit("order-"), F.col("id").cast("string")).alias("model"), F.array().cast("array<string>").alias("aliases")
    )
    return extract.drafts(models, TODAY).select("vendor", "shutdown", "title", "severity", F.size("models").alias("n"))


@query(RECORDS_SQL + """
, x AS (SELECT vendor, effective AS shutdown, 'm' || (id % 97) AS model FROM r WHERE kind = 'model' AND id % 2 = 0 GROUP BY ALL)
, k AS (SELECT DISTINCT vendor, effective AS shutdown, 'm' || (id % 97) AS model FROM r WHERE kind = 'model' AND id % 2 = 1)
SELECT vendor, shutdown, model FROM x ANTI JOIN k USING (vendor, shutdown, model)
""")
def uncovered_retirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retirements (even orders) that no record (odd ones) of the same vendor and day names."""
    rows = records(spark, sf_dir).where("kind = 'model'").withColumn("model", F.concat(F.lit("m"), (F.col("id") % 97).cast("string")))
    gone = rows.where("id % 2 = 0").select("vendor", F.col("effective").alias("shutdown"), "model", F.array().cast("array<string>").alias("aliases")).distinct()
    return extract.uncovered(gone, rows.where("id % 2 = 1").withColumn("signatures", F.array("model"))).select("vendor", "shutdown", "model")


@query("""
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS slug, s_name AS registry_name, 'https://' || lower(replace(s_name, '#', '-')) || '/' AS url, 'supplier ' || s_suppkey AS name FROM supplier),
a AS (SELECT CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN 'HTTPS://supplier-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE 'Supplier ' || c_custkey END AS asked FROM customer)
SELECT DISTINCT asked, coalesce((SELECT min(slug) FROM s WHERE slug = asked), (SELECT min(slug) FROM s WHERE registry_name = asked), (SELECT min(slug) FROM s WHERE rtrim(lower(url), '/') = rtrim(lower(asked), '/')), (SELECT min(slug) FROM s WHERE lower(name) = lower(asked))) AS slug
FROM a WHERE slug IS NOT NULL
""")
def server_lookup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    key = lambda c: F.col(c).cast("string")
    servers = suppliers.select(key("s_suppkey").alias("slug"), F.col("s_name").alias("registry_name"), F.concat(F.lit("https://"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit("/")).alias("url"), F.concat(F.lit("supplier "), key("s_suppkey")).alias("name"))
    padded, way = F.lpad(key("c_custkey"), 9, "0"), F.col("c_custkey") % 4
    asked = F.when(way == 0, key("c_custkey")).when(way == 1, F.concat(F.lit("Supplier#"), padded)).when(way == 2, F.concat(F.lit("HTTPS://supplier-"), padded)).otherwise(F.concat(F.lit("Supplier "), key("c_custkey")))
    return history.find_server(servers, customers.select(asked.alias("asked")))

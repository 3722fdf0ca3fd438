"""Queries on what goes out, and on documents that come in: feeds, answers, tables and logs in prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions.dates import parse_date, since
from ..operators import code_context, extract, feed, report, service, tokens
from .base import RECORDS_SQL, TODAY, Catalog, records, spread, table

CATALOG = Catalog()
query = CATALOG.query
DAY = f"DATE '{TODAY}'"


@query(RECORDS_SQL + f"SELECT id, vendor, effective FROM r WHERE lower(vendor) = 'nation_7' AND effective BETWEEN {DAY} AND {DAY} + 365 ORDER BY effective, rank, id LIMIT 50")
def list_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vendor's next changes, its name without regard to case."""
    return service.list_upcoming(records(spark, sf_dir), TODAY, 365, "NATION_7").select("id", "vendor", "effective")


@query(RECORDS_SQL + f"""
, s AS (SELECT 'part-' || (price % 500) AS signature, * FROM r), a AS (SELECT 'part-' || p_partkey AS asked FROM part),
f AS (SELECT asked, id, effective, severity, row_number() OVER (PARTITION BY asked ORDER BY effective > {DAY} DESC, CASE WHEN effective > {DAY} THEN effective END ASC, CASE WHEN effective > {DAY} THEN id END ASC, effective DESC, id DESC) AS place,
  count(*) OVER (PARTITION BY asked) AS n FROM a JOIN s ON signature = asked)
SELECT a.asked, coalesce(n, 0)::BIGINT AS records, id, effective, severity FROM a LEFT JOIN (SELECT * FROM f WHERE place = 1) x ON x.asked = a.asked
""")
def check_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's records (by the last digits of an order's price), and the one that leads."""
    known = records(spark, sf_dir).withColumn("signatures", F.array(F.concat(F.lit("part-"), (F.col("price") % 500).cast("string"))))
    known = known.withColumn("kind", F.lit("rest"))
    asked = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("asked"))
    return service.check_identifiers(known, asked, TODAY).select("asked", "records", "id", "effective", "severity")


@query(RECORDS_SQL + """, a AS (SELECT p_partkey AS n, p_partkey % 6 AS form FROM part)
SELECT CASE form WHEN 0 THEN 'vendor/PART-' || n WHEN 1 THEN 'part-' || n || '-20240101' ELSE 'part-' || n || '-mini' END AS asked, id FROM a JOIN r ON price % 500 = n WHERE form <= 2 AND n >= 10""")
def asked_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' models as people write them: in capitals behind a vendor, as snapshots, as variants that the record names or excludes, inside other words."""
    key = F.concat(F.lit("part-"), (F.col("price") % 500).cast("string"))
    rows = records(spark, sf_dir).where(F.col("price") % 500 >= 10)
    known = rows.select("id", "vendor", F.lit("model").alias("kind"), F.array(key).alias("signatures"), F.lit("also -mini and -old").alias("summary"), F.array(F.concat(key, F.lit("-old"))).alias("exclude"))
    n = F.col("p_partkey").cast("string")
    part = F.concat(F.lit("part-"), n)
    forms = [F.concat(F.lit("vendor/PART-"), n), F.concat(part, F.lit("-20240101")), F.concat(part, F.lit("-mini")), F.concat(part, F.lit(".5")), F.concat(F.lit("x"), part), F.concat(part, F.lit("-old"))]
    asked = table(spark, sf_dir, "part").select(F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int")).alias("asked"))
    return service.naming(known, asked).select("asked", "id")


@query(RECORDS_SQL + "SELECT id, vendor, '<entry><id>https://x/' || id || '.html</id><title>' || severity || ' &lt;' || kind || '&gt;</title><updated>' || strftime(effective, '%Y-%m-%dT00:00:00Z') || '</updated><link href=\"https://x/' || id || '.html\"/></entry>' AS element FROM r")
def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("summary", F.concat("severity", F.lit(" <"), "kind", F.lit(">")))
    return sinks.atom(rows, "https://x")


@query("SELECT '<url><loc>' || replace(url, '&', '&amp;') || '</loc></url>' AS element FROM pages WHERE NOT contains(url, '<')")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(~F.col("url").contains("<"))
    return sinks.sitemap(pages.select(F.col("url").alias("loc"), F.lit(None).cast("date").alias("lastmod")))


@query(RECORDS_SQL + f"""SELECT id, to_json({{'id': id::VARCHAR, 'url': 'https://x/' || id || '.html', 'title': severity || ' ' || kind, 'content_text': '', 'date': strftime(effective, '%Y-%m-%d'), 'tags': [vendor, severity, kind]}})::VARCHAR AS item
FROM r WHERE effective > DATE '{TODAY}'""")
def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that are still to come, as items of a JSON feed."""
    rows = records(spark, sf_dir).where(F.col("effective") > F.lit(TODAY).cast("date"))
    rows = rows.withColumns({"summary": F.concat_ws(" ", "severity", "kind"), "detail": F.lit("")})
    items = feed.feed_items(rows.withColumn("id", F.col("id").cast("string")), "https://x")
    return items.select(F.col("id").cast("long").alias("id"), "item")


@query(RECORDS_SQL + "SELECT id, effective AS day FROM r")
def dates_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's day, read again from a sentence in one of three forms."""
    day = F.col("effective")
    text = F.when(F.col("id") % 3 == 0, F.date_format(day, "MMMM d, yyyy")).when(F.col("id") % 3 == 1, F.date_format(day, "d MMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return records(spark, sf_dir).select("id", parse_date(F.concat(F.lit("It ends on "), text, F.lit(" for all."))).alias("day"))


@query(RECORDS_SQL + ", d AS (SELECT id, CASE id % 3 WHEN 0 THEN strftime(effective, '%Y-%m-%d') WHEN 1 THEN strftime(effective, '%Y-%m') ELSE '' END AS date_text FROM r) SELECT id, date_text FROM d WHERE date_text >= left('1998-06-15', length(date_text))")
def since_partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, F.date_format("effective", "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format("effective", "yyyy-MM")).otherwise("")
    return records(spark, sf_dir).select("id", text.alias("date_text")).where(since(F.col("date_text"), TODAY))


@query("SELECT doc_id, source || '|' || lang || '|' || left(sha1(trim(lower(regexp_replace('T | ' || left(text, 200), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')))), 16) AS key FROM documents")
def entry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells entries apart: source, day (here: language) and a digest of the squeezed text."""
    return table(spark, sf_dir, "documents").select("doc_id", extract.entry_key(F.col("source"), F.col("lang"), F.lit("T"), F.col("text")).alias("key"))


@query(RECORDS_SQL + """
, o AS (SELECT * FROM r WHERE price % 4 <> 0)
SELECT 'c' || customer AS vendor, 'm-' || id AS model, effective AS shutdown, ['n-' || (id + 1)] AS replacements FROM o
""")
def retirement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a Markdown table, and the table read again; rows without a date don't count."""
    day = F.when(F.col("price") % 4 == 0, "not before long").otherwise(F.date_format("effective", "MMMM d, yyyy"))
    row = F.concat(F.lit("| `m-"), F.col("id").cast("string"), F.lit("` | "), day, F.lit(" | `n-"), (F.col("id") + 1).cast("string"), F.lit("` |"))
    body = F.concat(F.lit("## Gone\n| Model | Shutdown date | Replacement |\n|--|--|--|\n"), F.array_join(F.collect_list(row), "\n"))
    pages = records(spark, sf_dir).groupBy("customer").agg(body.alias("markdown")).select(F.lit("orders").alias("source"), F.concat(F.lit("c"), F.col("customer").cast("string")).alias("vendor"), "markdown")
    return extract.retirements(pages).select("vendor", "model", "shutdown", "replacements")


@query(RECORDS_SQL + "SELECT 'c' || customer AS vendor, strftime(effective, '%Y-%m-%d') AS date_text, 'order ' || id || ' is ' || severity AS title FROM r")
def changelog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a changelog (a heading a day, a bullet an order), read again."""
    bullet = F.concat(F.lit("- order "), F.col("id").cast("string"), F.lit(" is "), "severity")
    day = records(spark, sf_dir).groupBy("customer", "effective").agg(F.array_join(F.collect_list(bullet), "\n").alias("bullets"), F.count("*").alias("n"))
    # a day's only bullet is an entry with the day for a title
    section = F.concat(F.lit("## "), F.date_format("effective", "MMMM d, yyyy"), F.lit("\n"), "bullets", F.lit("\n"))
    pages = day.groupBy("customer").agg(F.array_join(F.collect_list(section), "\n").alias("body")).select(F.lit("log").alias("source"), F.concat(F.lit("c"), F.col("customer").cast("string")).alias("vendor"), "body")
    return extract.changelog(pages).select("vendor", "date_text", F.regexp_replace("text", r"\A- ", "").alias("title"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a Python file that uses, lists, comments on and exports its brand."""
    brand, n = F.concat(F.lit('"'), "p_brand", F.lit('"')), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("# "), "p_brand", F.lit("\nNAME"), n, F.lit(" = "), brand, F.lit("\nALL = ["), brand, F.lit(", 1]\ndef f(x):\n    return x.get(NAME"), n, F.lit(")\nf("), brand, F.lit(")\n"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.concat(F.lit("src/p"), n, F.lit(".py")).alias("path"), F.lit(".py").alias("suffix"), text.alias("text"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import lines

    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array("p_brand").alias("signatures")).select(F.col("p_brand").alias("id"), "signatures", F.lit("rest").alias("kind"))
    rows = lines(_code(spark, sf_dir), "text", ["path"]).select(F.col("path").alias("file"), F.col("line_no").alias("n"), "line")
    return tokens.token_hits(rows, tokens.signature_table(brands), ["file", "n"]).drop("line").withColumnRenamed("n", "line")


@query("SELECT 'src/p' || p_partkey || '.py' AS file, p_brand AS record_id, x[1]::INTEGER AS line, CASE WHEN x[1] = 3 THEN 'listed' ELSE 'use' END AS tier FROM part, (SELECT unnest([[2], [3], [6]]) AS x)")
def hit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.tiers(_hits(spark, sf_dir), _code(spark, sf_dir)).select("file", "record_id", "line", "tier")


@query("SELECT 'src/p' || p_partkey || '.py' AS file, p_brand AS record_id, 5::INTEGER AS line, 'NAME' || p_partkey || ' (src/p' || p_partkey || '.py:2)' AS via FROM part")
def constant_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _code(spark, sf_dir)
    return code_context.constant_uses(code_context.tiers(_hits(spark, sf_dir), files), files).select("file", "record_id", "line", "via")


_RULE = """b AS (SELECT DISTINCT p_brand AS b FROM part),
rule AS (SELECT row_number() OVER (ORDER BY b) AS i, count(*) OVER () AS n, to_json({'id': b, 'name': b, 'shortDescription': {'text': 'V: ' || b}, 'fullDescription': {'text': 'About ' || b}, 'help': {'text': 'See source.' || chr(10) || chr(10) || 'Source: https://x (unreviewed draft: confirm before acting)'}, 'helpUri': 'https://x',
  'defaultConfiguration': {'level': 'error'}, 'properties': {'tags': ['V', 'rest', 'breaking'], 'effective': '2026-01-02'}})::VARCHAR AS line FROM b),
s AS (SELECT p_brand AS b, 'src/p' || p_partkey || '.py' AS file, x[1]::INTEGER AS l FROM part, (SELECT unnest([[2], [3], [6]]) AS x)),
result AS (SELECT row_number() OVER (ORDER BY b, file, l) AS i, count(*) OVER () AS n, to_json({'ruleId': b, 'level': CASE l WHEN 3 THEN 'note' ELSE 'error' END, 'message': {'text': 'V breaking change effective 2026-01-02: ' || b || ' (`' || b || '`)' || CASE l WHEN 3 THEN ' [listed in a table or enum, not a request]' ELSE '' END},
  'locations': [{'physicalLocation': {'artifactLocation': {'uri': file}, 'region': {'startLine': l}}}], 'partialFingerprints': {'site': sha256(b || ':' || file || ':' || b || ':' || b)}, 'properties': {'inTest': false, 'tier': CASE l WHEN 3 THEN 'listed' ELSE 'use' END}})::VARCHAR AS line FROM s)"""


@query(f"""WITH {_RULE}, k AS (SELECT count(*) AS rules FROM rule), m AS (SELECT count(*) AS results FROM result)
SELECT 1::BIGINT AS place, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"changelens","rules":[' AS line UNION ALL SELECT i + 1, line || CASE WHEN i < n THEN ',' ELSE '' END FROM rule
UNION ALL SELECT rules + 2, ']}}}},"results":[' FROM k UNION ALL SELECT rules + 2 + i, line || CASE WHEN i < n THEN ',' ELSE '' END FROM result, k UNION ALL SELECT rules + results + 3, ']}}]}}' FROM k, m""")
def sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code hits of all parts as the lines of a SARIF document."""
    sites = code_context.tiers(_hits(spark, sf_dir), _code(spark, sf_dir)).withColumns({"snippet": F.col("signature"), "via": F.lit("")})
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    known = {"vendor": "V", "kind": "rest", "severity": "breaking", "fix_hint": "", "source_url": "https://x", "verified": False, "verified_by": None}
    rows = brands.select("id", F.col("id").alias("summary"), F.concat(F.lit("About "), "id").alias("detail"), F.lit("2026-01-02").cast("date").alias("effective"), F.lit(None).cast("date").alias("verified_on"), *[F.lit(v).cast("boolean" if v is False else "string").alias(k) for k, v in known.items()])
    return report.sarif(sites, rows, "changelens")

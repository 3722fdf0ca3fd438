"""Queries on texts: identifiers in lines, evidence, pages, changelogs, dependency lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import in_test, is_ignored, json_hash, lines
from ..operators import evidence, extract, report, tokens
from ..sources import deps
from .base import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

#: Identifiers to look for, and how bad their change is.
SIGNATURES = [("breaking", "token"), ("breaking", "moron"), ("silent", "onharent"), ("deprecation", "the"), ("deprecation", "Zu und"), ("additive", "example.com"), ("info", "of them")]
#: A token's sides in a dialect without look-around: no word character, and no dot with a digit after it.
_LEFT, _RIGHT = "(^|[^A-Za-z0-9_])", r"($|[^A-Za-z0-9_.\\]|[.]($|[^0-9])|\\($|[^.]|[.]($|[^0-9])))"
_LITERALS = ", ".join(f"('{sev}', '{sig}', '{_LEFT}{sig.replace('.', '[.]')}{_RIGHT}')" for sev, sig in SIGNATURES)
#: A line without ``the`` before a dot and a digit, for counting by word boundaries.
_PLAIN_LINE = r"regexp_replace(line, '\bthe\b(\\?[.][0-9])', 'Q\1', 'g')"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def signatures(spark: SparkSession) -> DataFrame:
    rows = [(f"{sev}-{sig}", [sig], "rest", sev) for sev, sig in SIGNATURES]
    found = spark.createDataFrame(rows, "id string, signatures array<string>, kind string, severity string")
    return tokens.signature_table(found).join(F.broadcast(found.select(F.col("id").alias("record_id"), "severity")), "record_id")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_hits(document_lines(spark, sf_dir), signatures(spark), ["doc_id", "line_no"])


@query(f"WITH {_LINES}, s(severity, signature, pattern) AS (VALUES {_LITERALS}) SELECT doc_id, signature, count(*)::BIGINT AS lines FROM l JOIN s ON regexp_matches(line, pattern) GROUP BY ALL")
def token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("doc_id", "signature").agg(F.countDistinct("line_no").alias("lines"))


@query(f"WITH {_LINES}, s(severity, signature, pattern) AS (VALUES {_LITERALS}) SELECT severity, count(*)::BIGINT AS sites, count(DISTINCT doc_id)::BIGINT AS files FROM l JOIN s ON regexp_matches(line, pattern) GROUP BY ALL")
def token_hits_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and documents in which an identifier of each severity stands."""
    sites = hits(spark, sf_dir).groupBy("severity", "signature", "doc_id").agg(F.countDistinct("line_no").alias("n"))
    return sites.groupBy("severity").agg(F.sum("n").alias("sites"), F.countDistinct("doc_id").alias("files"))


@query(rf"WITH {_LINES} SELECT doc_id, sum(len(regexp_extract_all({_PLAIN_LINE}, '\bof the\b')))::BIGINT AS long_hits, sum(len(regexp_extract_all(regexp_replace({_PLAIN_LINE}, '\bof the\b', 'Q', 'g'), '\bthe\b')))::BIGINT AS short_hits FROM l GROUP BY doc_id HAVING long_hits + short_hits > 0")
def longest_signature_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``of the``, and of ``the`` outside of them; ``of the`` that begins inside a word (``proof the``) is no hit, and covers none."""
    found = spark.createDataFrame([("r", ["of the", "the"], "rest")], "id string, signatures array<string>, kind string")
    rows = tokens.token_hits(document_lines(spark, sf_dir), tokens.signature_table(found), ["doc_id", "line_no"])
    rows = tokens.longest_wins(rows, ["record_id", "doc_id", "line_no"])
    return rows.groupBy("doc_id").agg(F.count_if(F.col("signature") == "of the").alias("long_hits"), F.count_if(F.col("signature") == "the").alias("short_hits"))


@query(rf"WITH {_LINES} SELECT doc_id, sum(len(regexp_extract_all(replace({_PLAIN_LINE}, 'of the', 'Q'), '\bthe\b')))::BIGINT AS hits FROM l GROUP BY doc_id HAVING hits > 0")
def excluded_span_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``the`` that no ``of the`` covers."""
    found = spark.createDataFrame([("r", ["the"], "rest")], "id string, signatures array<string>, kind string")
    rows = tokens.token_hits(document_lines(spark, sf_dir), tokens.signature_table(found), ["doc_id", "line_no"])
    return tokens.not_excluded(rows, ["of the"]).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("SELECT lang, count(*)::BIGINT AS docs FROM documents WHERE contains(lower(text), 'token') OR (contains(lower(text), 'moron') AND contains(lower(text), 'pathetic')) GROUP BY lang")
def context_dnf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(F.array(F.lit("TOKEN")), F.array(F.lit("moron"), F.lit("Pathetic")))
    return table(spark, sf_dir, "documents").where(tokens.context_matches(F.col("text"), groups)).groupBy("lang").agg(F.count("*").alias("docs"))


@query("SELECT source, bool_or(contains(lower(text), 'token')) AND bool_or(contains(lower(text), 'moron')) AS matches FROM documents GROUP BY source")
def repo_context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that hold all words of a group, in whichever documents."""
    docs = table(spark, sf_dir, "documents")
    repos = tokens.repo_words(docs, ["token", "moron", "password"], "source")
    need = spark.createDataFrame([("r", [["token", "moron"]])], "id string, repo_context array<array<string>>")
    found = tokens.repo_context(need, repos.withColumnRenamed("source", "repo")).select(F.col("repo").alias("source"), F.lit(True).alias("hit"))
    return repos.join(found, "source", "left").select("source", F.coalesce("hit", F.lit(False)).alias("matches"))


_CONTAINED = "SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query(f"SELECT item_id, count(*)::BIGINT AS docs FROM ({_CONTAINED}) GROUP BY item_id")
def corpus_gate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations that some document holds, and how many do."""
    return evidence.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id").groupBy("item_id").agg(F.count("*").alias("docs"))


@query("""WITH q AS (SELECT doc_id, regexp_extract(text, '(?s)^([^ ]* [^ ]*)', 1) AS a FROM documents), w AS (SELECT DISTINCT a FROM q WHERE a <> '' AND length(a) BETWEEN 12 AND 400),
d AS (SELECT DISTINCT text FROM documents) SELECT a AS quote, count(*)::BIGINT AS texts FROM w JOIN d ON contains(text, a) GROUP BY a""")
def short_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many different texts the first two words of each document stand."""
    documents = table(spark, sf_dir, "documents")
    first = documents.select(F.regexp_extract("text", r"(?s)\A([^ ]* [^ ]*)", 1).alias("text")).distinct().where("text != '' and char_length(text) between 12 and 400")
    texts = documents.select(F.sha2("text", 256).alias("t"), "text").dropDuplicates(["t"])
    found = evidence.containment(first.select(F.col("text").alias("quote"), "text"), texts, "quote", "t")
    return found.groupBy("quote").agg(F.count("*").alias("texts"))


@query(f"SELECT b.item_id, CASE WHEN c.item_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM benchmark b LEFT JOIN (SELECT DISTINCT item_id FROM ({_CONTAINED})) c USING (item_id)")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    found = evidence.containment(items, table(spark, sf_dir, "documents"), "item_id", "doc_id").select("item_id").distinct()
    return items.select("item_id").join(found.withColumn("_ok", F.lit(True)), "item_id", "left").select("item_id", F.when(F.col("_ok"), "ok").otherwise("missing").alias("status"))


@query("""WITH p AS (SELECT page_id AS id, contains(html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS ok FROM pages)
SELECT id, CASE WHEN ok THEN 'ok' ELSE 'missing' END AS status, []::VARCHAR[] AS missing, []::VARCHAR[] AS errors FROM p""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's own title stands in it, in normal form (each page quotes itself)."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    quotes = pages.select(F.col("page_id").alias("id"), F.col("url").alias("source_url"), F.array(F.struct(F.col("url"), title.alias("text"))).alias("evidence"))
    return evidence.check(quotes, pages.select("url", F.col("html").alias("text"), F.lit("").alias("error")).dropDuplicates(["url"]))


_PATTERNS = ["en/", "*.html", "old-*", "https://m.*"]


@query("""
SELECT page_id, contains('/' || url, '/en/') OR list_bool_or(list_transform(string_split(url, '/'), lambda p: regexp_full_match(p, '(?s).*[.]html') OR regexp_full_match(p, '(?s)old-.*')))
  OR regexp_full_match(url, '(?s).*[.]html') OR regexp_full_match(url, '(?s)https://m[.].*') AS ignored FROM pages
""")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_ignored(F.col("url"), _PATTERNS).alias("ignored"))


_PATHS = "CASE page_id % 5 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'src/Spec/' WHEN 2 THEN 'src/contest/' WHEN 3 THEN 'lib/test_' ELSE 'lib/' END || page_id || CASE WHEN page_id % 3 = 0 THEN '.test.js' ELSE '.js' END"


@query(f"SELECT page_id, page_id % 5 IN (0, 1, 3) OR page_id % 3 = 0 AS in_test FROM (SELECT page_id, {_PATHS} AS path FROM pages)")
def test_path_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS).alias("path")).select("page_id", in_test(F.col("path")).alias("in_test"))


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_PLAIN}) AS digest, length({_PLAIN})::INTEGER AS size FROM pages")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.char_length("t").alias("size"))


@query("SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links, regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS headings FROM pages")
def page_links_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("links"), F.regexp_extract_all("html", F.lit("(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)).alias("headings"))


@query(r"""
WITH f AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(moron|token)\b'), lambda w: lower(w)))) AS s,
  list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(with|from|pathetic)\b'), lambda w: lower(w)))) AS w FROM documents)
SELECT doc_id, list_sort(list_distinct(list_concat(s, w))) AS flags FROM f WHERE len(s) > 0 OR len(w) > 1
""")
def lead_flags_strong_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.flagged(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["moron", "token"], ["with", "from", "pathetic"]).select("doc_id", "flags")


@query(rf"WITH {_LINES}, h AS (SELECT doc_id, source, count(*) AS n FROM l JOIN documents USING (doc_id) WHERE regexp_matches(line, '{_LEFT}moron{_RIGHT}') GROUP BY ALL), p AS (SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, sum(n) OVER (PARTITION BY source) AS lines FROM h) SELECT source, doc_id, place::INTEGER AS place, lines::BIGINT AS lines FROM p WHERE place <= 5")
def top_n_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's first five documents with a hit, and how many lines hit in all."""
    found = spark.createDataFrame([("r", ["moron"], "rest")], "id string, signatures array<string>, kind string")
    rows = lines(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    rows = tokens.token_hits(rows, tokens.signature_table(found), ["doc_id", "source", "line_no"]).groupBy("source", "doc_id").agg(F.countDistinct("line_no").alias("n"))
    rows = rows.withColumn("lines", F.sum("n").over(Window.partitionBy("source")))
    return report.top_sites(rows, 5, ["source"], ["doc_id"]).select("source", "doc_id", "place", "lines")


@query(rf"WITH {_LINES}, h AS (SELECT doc_id FROM l WHERE regexp_matches(line, '{_LEFT}the{_RIGHT}')) SELECT doc_id % 10 AS bucket, count(*)::BIGINT AS sites, count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 <> 0)::BIGINT AS in_code, count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 = 0)::BIGINT AS listed, count(*) FILTER (doc_id % 2 = 0)::BIGINT AS in_test FROM h GROUP BY ALL")
def scan_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hit, by whether their file (named after the document) is code, a list or a test."""
    found = spark.createDataFrame([("r", ["the"], "rest")], "id string, signatures array<string>, kind string")
    rows = tokens.token_hits(document_lines(spark, sf_dir), tokens.signature_table(found), ["doc_id", "line_no"]).select("doc_id", "line_no").distinct()
    file = F.concat(F.when(F.col("doc_id") % 2 == 0, "tests/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".py"))
    sites = rows.select((F.col("doc_id") % 10).alias("bucket"), file.alias("file"), F.when(F.col("doc_id") % 3 == 0, "listed").otherwise("use").alias("tier"))
    return report.split_counts(sites, by=["bucket"])


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS hash FROM part""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of JSON texts whose keys stand in another order."""
    body = F.concat(F.lit('{ "size": '), F.col("p_size").cast("string"), F.lit(', "name": "'), "p_name", F.lit('",  "brand": "'), "p_brand", F.lit('"}'))
    return table(spark, sf_dir, "part").select("p_partkey", json_hash(body).alias("hash"))


@query("""
SELECT p_partkey, 'pypi' AS ecosystem, false AS is_lock, replace(lower(p_brand), '#', '-') AS name, CASE WHEN p_size % 2 = 0 THEN p_size || '.x' ELSE p_size || '.' || p_size % 7 END AS version FROM part
""")
def dep_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement lines of each part's brand and size."""
    v = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string")))
    text = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(">="), v, F.lit(" ; python_version > '3'\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/requirements.txt")).alias("path"), text.alias("text"))
    return deps.dependency_pins(files).select(F.col("dir").cast("long").alias("p_partkey"), "ecosystem", "is_lock", "name", "version")


@query("SELECT conv_id, turn, list(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def prev_lines_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of the three turns before each one."""
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    before = F.collect_list("role").over(window)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(before) > 0, before).alias("before"))


@query(f"WITH {_LINES}, s(severity, signature, pattern) AS (VALUES {_LITERALS}), m AS (SELECT signature, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM l JOIN s ON regexp_matches(line, pattern) GROUP BY signature) SELECT s.signature, first_doc, coalesce(docs, 0)::BIGINT AS docs FROM s LEFT JOIN m USING (signature)")
def identifier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each identifier asked for: the documents that name it."""
    found = hits(spark, sf_dir).groupBy("signature").agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("docs"))
    asked = spark.createDataFrame([(s,) for _, s in SIGNATURES], "signature string")
    return asked.join(found, "signature", "left").select("signature", "first_doc", F.coalesce("docs", F.lit(0)).alias("docs"))

"""Queries on what makes a token a site; each part is a line or a file of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import code_context, extract, feed, report, scan, tokens
from ..sources import code
from . import state
from .base import RECORDS_SQL, TODAY, Catalog, parts, records, spread, table

CATALOG = Catalog()
query = CATALOG.query
RECORD = "id string, signatures array<string>, kind string, vendor string, summary string, detail string, surface string"


def _pick(n: int, *texts: str) -> Column:
    """One of n texts by a part's number."""
    return F.element_at(F.array(*map(F.lit, texts)), F.col("p_partkey").cast("int") % n + 1)


@query("""WITH l AS (SELECT p_partkey AS k, p_partkey % 3 AS m, p_partkey // 3 % 6 AS s FROM part)
SELECT k AS p_partkey, 'r' || m AS record_id, 4::INTEGER AS start FROM l WHERE s IN (0, 1, 3, 4) OR (s = 2 AND m = 1)""")
def named_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of models with suffixes: snapshots and what a record's text names are the record's, others aren't."""
    rows = [(f"r{i}", [f"nova-{i}"], "model", "V", "Gone, with the -mini ones and Nova-1-max.", "", "") for i in range(3)]
    suffix = F.element_at(F.array(*map(F.lit, ("", "-mini", "-max", "-20240613", "-20240613-mini", "-pro"))), F.expr("int(p_partkey div 3 % 6) + 1"))
    rows_of = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("use "), _pick(3, "nova-0", "nova-1", "nova-2"), suffix, F.lit(" now")).alias("line"))
    return tokens.token_hits(rows_of, scan.named_signatures(spark.createDataFrame(rows, RECORD)), ["p_partkey"], F.col("named")).select("p_partkey", "record_id", "start")


@query("""SELECT p_partkey, 'other' AS record_id, count(*)::BIGINT AS hits FROM part, (SELECT unnest([1, 2, 2, 3]) AS s) WHERE p_partkey % 4 = s GROUP BY ALL
UNION ALL SELECT p_partkey, 'own', CASE p_partkey % 4 WHEN 2 THEN 2 ELSE 1 END FROM part WHERE p_partkey % 4 IN (2, 3)""")
def partner_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a vendor's id in the forms in which partners serve it."""
    rows = [("own", ["nova-1"], "model", "Anthropic"), ("other", ["nova-1"], "model", "Other")]
    records = spark.createDataFrame(rows, "id string, signatures array<string>, kind string, vendor string")
    found = table(spark, sf_dir, "part").select("p_partkey", _pick(4, "anthropic.nova-1-20250219-v1:0", "nova-1@20250219", "nova-1@2025 or nova-1", "nova-1").alias("line"))
    hits = tokens.token_hits(found, tokens.signature_table(records), ["p_partkey"]).join(F.broadcast(records.select(F.col("id").alias("record_id"), "vendor")), "record_id")
    return scan.not_partner(hits, ["record_id", "p_partkey", "signature"]).groupBy("p_partkey", "record_id").agg(F.count("*").alias("hits"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 NOT IN (1, 3) OR p_partkey // 5 % 3 = 2")
def data_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose line sets an id, or stands in a file of code; sentences in data files don't count."""
    text = _pick(5, 'model: nova-1', 'description: "The older nova-1 model is going away for all callers at the end of the year"', "- nova-1 # which we have used for the whole of the last year, and for some of this one", "summary: the nova-1 model is retired and all callers have to move on by the end of the year", "run: tool --model nova-1 for the whole of the test suite in every one of the jobs")
    suffix = F.element_at(F.array(*map(F.lit, (".yaml", ".toml", ".py"))), F.expr("int(p_partkey div 5 % 3) + 1"))
    rows = table(spark, sf_dir, "part").select("p_partkey", suffix.alias("suffix"), text.alias("line"))
    records = spark.createDataFrame([("r", ["nova-1"], "model")], "id string, signatures array<string>, kind string")
    return scan.not_prose(tokens.token_hits(rows, tokens.signature_table(records), ["p_partkey", "suffix"])).select("p_partkey")


@query("SELECT p_partkey, 2::INTEGER AS line_no FROM part WHERE p_partkey % 4 IN (1, 3)")
def excluded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with a call over several lines; calls with a status are excluded."""
    call = _pick(4, "x.list({\n  status: 1 })", "x.list({\n  other: 1 })", "y(x.list( {status : 2 }))", "x.list\n({ status: 3 })")
    keys = table(spark, sf_dir, "part").select("p_partkey")
    n = keys.count()
    files = spread(keys, "p_partkey", rows=n).select(F.col("p_partkey").alias("file"), F.concat(F.lit("begin\n"), call, F.lit("\nend\n")).alias("text"))
    rows = lines(files, "text", ["file"])
    records = spark.createDataFrame([("r", ["x.list"], "rest")], "id string, signatures array<string>, kind string")
    hits = tokens.token_hits(rows, tokens.signature_table(records), ["file", "line_no"]).withColumn("excludes", F.array(F.lit("x.list({ status:")))
    return scan.not_called(hits, rows, partitions=parts(keys, n)).select(F.col("file").alias("p_partkey"), "line_no")


@query("""SELECT p_partkey, 'mcp' AS signature, 0::INTEGER AS start FROM part
UNION ALL SELECT p_partkey, s, 4 FROM part JOIN (SELECT DISTINCT p_size::VARCHAR AS s FROM part) ON s = p_partkey::VARCHAR""")
def short_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' numbers behind a word, for records of that word and of every size: one letter or digit is a signature too."""
    parts = table(spark, sf_dir, "part")
    signatures = parts.select(F.col("p_size").cast("string").alias("s")).union(parts.select(F.lit("mcp"))).distinct()
    wanted = signatures.select(F.col("s").alias("id"), F.array("s").alias("signatures"), F.lit("rest").alias("kind"))
    rows = parts.select("p_partkey", F.concat(F.lit("mcp "), F.col("p_partkey").cast("string"), F.lit(" x")).alias("line"))
    return tokens.token_hits(rows, tokens.signature_table(wanted), ["p_partkey"]).select("p_partkey", "signature", "start")


@query("""WITH s AS (SELECT DISTINCT 'L' || l_orderkey || '-' || l_linenumber AS s FROM lineitem),
l AS (SELECT o_orderkey, unnest([['0', '-1'], ['1', '-2']]) AS x FROM orders)
SELECT o_orderkey, s AS signature, CASE x[1] WHEN '0' THEN 4 ELSE 12 + length(o_orderkey::VARCHAR) END::INTEGER AS start FROM l JOIN s ON s = 'L' || o_orderkey || x[2]""")
def many_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name two line items, and a third as a part of another name, for a record of each line item: more signatures than an automaton takes."""
    item = lambda key, n: F.concat(F.lit("L"), F.col(key).cast("string"), F.lit("-"), n)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    name = item("l_orderkey", F.col("l_linenumber").cast("string"))
    wanted = lambda rows: tokens.signature_table(rows.select(name.alias("id"), F.array(name).alias("signatures"), F.lit("rest").alias("kind")))
    key = "o_orderkey"
    line = F.concat(F.lit("see "), item(key, F.lit("1")), F.lit(" and "), item(key, F.lit("2")), F.lit(", not "), item(key, F.lit("3x")))
    rows = table(spark, sf_dir, "orders").select(key, line.alias("line"))
    return tokens.token_hits(rows, wanted(items.distinct()), [key], forms=wanted(items)).select(key, "signature", "start")


@query("""WITH t AS (SELECT p_partkey AS k, p_brand AS b, p_partkey % 6 AS m FROM part), u AS (SELECT k, b, unnest(CASE m WHEN 0 THEN [2] WHEN 1 THEN [4, 5] WHEN 2 THEN [3] WHEN 3 THEN [2] WHEN 4 THEN [4, 5] ELSE [6] END) AS line, m FROM t)
SELECT k AS p_partkey, b AS signature, line::INTEGER AS line, 'M (f' || k || CASE m % 2 WHEN 0 THEN '.ts:' ELSE '.js:' END || CASE m WHEN 4 THEN 2 WHEN 5 THEN 4 ELSE 1 END || ')' AS via FROM u""")
def script_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's brand as a script's constant: under a long type, in a template of several lines, among keys, hidden in a block, within a block, beside a pattern."""
    b = F.col("p_brand")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [
        text("const M: ", F.repeat(F.lit("string | "), F.col("p_size") * 40), "null = '", b, "'\ng(M)\n"),
        text("export const M = `\n", b, "\n`\ng(`${M}`)\nx ? M : y\n"),
        text("const M = '", b, "'\ng({ M: 1 })\ng({ a: M })\n// M\n"),
        text("const M = '", b, "'\nif (M) {\n  const M = other()\n  g(M)\n}\n"),
        text("function f(x) {\n  const M = '", b, "'; if (x) {\n  }\n  switch (x) { case M: break }\n  g(M)\n}\ng(M)\n"),
        text("x = a / b\ny = c.replace(/[{'`]/g, '')\nif (y) {\n  const M = `", b, "`\n  const o = {\n    a: M\n  }\n}\n"),
    ]
    suffix = F.when(F.col("p_partkey") % 2 == 0, ".ts").otherwise(".js")
    files = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), suffix).alias("path"), suffix.alias("suffix"), F.element_at(F.array(*forms), F.col("p_partkey").cast("int") % 6 + 1).alias("text"))
    brands = table(spark, sf_dir, "part").select(b.alias("id"), F.array(b).alias("signatures"), F.lit("rest").alias("kind")).dropDuplicates(["id"])
    rows = lines(files, "text", ["path"]).select(F.col("path").alias("file"), F.col("line_no").alias("n"), "line")
    hits = tokens.token_hits(rows, tokens.signature_table(brands), ["file", "n"]).drop("line").withColumnRenamed("n", "line")
    found = code_context.constant_uses(hits, files)
    return found.select(F.regexp_extract("file", "[0-9]+", 0).cast("long").alias("p_partkey"), "signature", "line", "via")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a script that defines its brand, in a block and for others; and one that takes it from there."""
    n = F.col("p_partkey").cast("string")
    brand = F.concat(F.lit("'"), "p_brand", F.lit("'"))
    home = F.concat(F.lit("export const NAME"), n, F.lit(" = "), brand, F.lit("\nfunction f() {\n  const inner = "), brand, F.lit("\n  return g(inner)\n}\ng(inner)\n"))
    away = F.concat(F.lit("import { NAME"), n, F.lit(" as Mine } from './p"), n, F.lit("'\ng({ Mine: 1 }, "), F.lit("Mine)\n"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    own = parts.select(F.concat(F.lit("src/p"), n, F.lit(".ts")).alias("path"), F.lit(".ts").alias("suffix"), home.alias("text"))
    return own.unionByName(parts.select(F.concat(F.lit("src/q"), n, F.lit(".js")).alias("path"), F.lit(".js").alias("suffix"), away.alias("text")))


_ALL_SITES = """a AS (SELECT p_brand AS record_id, p_brand AS signature, p_partkey AS k FROM part),
s AS (SELECT record_id, signature, 'src/p' || k || '.ts' AS file, x[1]::INTEGER AS line, CASE x[1] WHEN 4 THEN 'inner (src/p' || k || '.ts:3)' ELSE '' END AS via FROM a, (SELECT unnest([[1], [3], [4]]) AS x)
  UNION ALL SELECT record_id, signature, 'src/q' || k || '.js', 2, 'NAME' FROM a),
u AS (SELECT record_id, signature, file, line, CASE via WHEN 'NAME' THEN 'Mine (src/p' || regexp_extract(file, '[0-9]+') || '.ts:1)' ELSE via END AS via FROM s)"""


@query(f"WITH {_ALL_SITES} SELECT * FROM u")
def all_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct hits in scripts, and the uses of constants that hold them, in their block or where they are imported."""
    files = _scripts(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.array("p_brand").alias("signatures"), F.lit("rest").alias("kind")).dropDuplicates(["id"])
    rows = lines(files, "text", ["path"]).select(F.col("path").alias("file"), F.col("line_no").alias("n"), "line")
    hits = tokens.token_hits(rows, tokens.signature_table(brands), ["file", "n"]).drop("line").withColumnRenamed("n", "line")
    return scan.sites(hits, files)


@query(f"WITH {_ALL_SITES} SELECT u.* FROM u WHERE ends_with(file, '.js') OR CAST(regexp_extract(file, '[0-9]+') AS BIGINT) % 2 = 0")
def changed_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites in files that a change touches: all users, and every other definition."""
    n = F.col("p_partkey").cast("string")
    parts = table(spark, sf_dir, "part")
    changed = parts.select(F.concat(F.lit("/src\\q"), n, F.lit(".js")).alias("path")).unionByName(parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("src/p"), n, F.lit(".ts")).alias("path")))
    return scan.only_files(all_sites(spark, sf_dir), changed)


@query(f"SELECT pair, path, replace(string_split(path, '.')[-1], '[]', '') AS signature FROM ({state.CATALOG.oracles['schema_diff']}) WHERE path <> '$'")
def drift_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look for in code after each event of ``schema_diff``."""
    return scan.drift_signatures(state.schema_diff(spark, sf_dir)).select("pair", "path", "signature")


@query(f"""WITH {_ALL_SITES} SELECT record_id, file, line, signature, '{{"record":{{"id":"' || record_id || '","vendor":"V","severity":"breaking","effective":"2026-01-02","summary":"gone","source_url":"https://x"}},"site":{{"file":"' || file || '","line":' || line || ',"signature":"' || signature || '","via":"' || via || '","in_test":false}}}}' AS item FROM u""")
def scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of ``all_sites`` as lines of JSON, each with its record."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    records = brands.select("id", F.lit("V").alias("vendor"), F.lit("breaking").alias("severity"), F.lit("2026-01-02").cast("date").alias("effective"), F.lit("gone").alias("summary"), F.lit("https://x").alias("source_url"))
    return report.scan_items(all_sites(spark, sf_dir), records)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN '' ELSE 'Applies only in ' || array_to_string(list_filter([
  CASE WHEN p_partkey % 2 = 1 THEN 'files matching "*.py", "' || p_brand || '"' END, CASE p_partkey % 3 WHEN 1 THEN 'files that mention "a" and "b"' WHEN 2 THEN 'files that mention "a" or ''b"'' or "c" or "d" or 2 more' END,
  CASE p_partkey % 5 WHEN 1 THEN 'repos that depend on "x ' || p_size || '.x" (pypi) or "y 2.x"' WHEN 2 THEN 'repos that depend on "x 1.x"; or repos that mention "z" (including dependency manifests)' WHEN 3 THEN 'repos that mention "z" (including dependency manifests)' WHEN 4 THEN 'repos that mention "z" and "w" (including dependency manifests)' END], lambda x: x IS NOT NULL), '; ') || '.' END AS scope FROM part""")
def scope_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which files and repositories a record counts, in words."""
    words = lambda *groups: F.array(*[F.array(*[g if isinstance(g, Column) else F.lit(g) for g in group]) for group in groups])
    k = F.col("p_partkey")
    context = F.when(k % 3 == 1, words(["a", "b"])).when(k % 3 == 2, words(["a"], ['b"'], ["c"], ["d"], ["e"], ["f"]))
    files = F.when(k % 2 == 1, F.array(F.lit("*.py"), F.col("p_brand")))
    own = F.concat(F.lit("dep:pypi:x@"), F.col("p_size").cast("string"), F.lit("."))
    repos = F.when(k % 5 == 1, words([own], ["dep:y@2."])).when(k % 5 == 2, words(["z"], ["dep:x@1"])).when(k % 5 == 3, words(["z"])).when(k % 5 == 4, words(["z", "w"]))
    return table(spark, sf_dir, "part").select("p_partkey", feed.scope_text(context, files, repos).alias("scope"))


@query(RECORDS_SQL + f"""
, s AS (SELECT *, 'Part.' || (price % 500) AS signature FROM r WHERE kind = 'model' AND id % 5 <> 0), f AS (SELECT replace(lower(signature), '.', '-') AS slug, * FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY effective > DATE '{TODAY}' DESC, CASE WHEN effective > DATE '{TODAY}' THEN effective END ASC, CASE WHEN effective > DATE '{TODAY}' THEN id END ASC, effective DESC, id DESC) AS place FROM f)
SELECT vendor, slug, signature AS spelling, id, effective, severity FROM p WHERE place = 1""")
def identifiers_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers with a page, under the vendor of the record that leads them; every fifth record has a scope, and every record a fragment of code."""
    price = (F.col("price") % 500).cast("string")
    none = F.array().cast("array<array<string>>")
    rows = records(spark, sf_dir).withColumns({
        "signatures": F.array(F.concat(F.lit("Part."), price), F.concat(F.lit("x"), price, F.lit("={")), F.lit("abc"), F.lit("1234")), "context": F.when(F.col("id") % 5 == 0, F.array(F.array(F.lit("c")))).otherwise(none),
        "files": F.lit(None).cast("array<string>"), "repo_context": none,
    })
    return feed.identifiers_by_vendor(rows, TODAY)


@query(RECORDS_SQL + """
SELECT 'c' || customer AS vendor, strftime(effective, '%Y-%m-%d') AS date_text, 'order ' || id AS title, 'https://x/' || id AS url FROM r""")
def changelog_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a changelog in one of three layouts: a line with the day above a heading, a table of links under a day, or a linked row under a day that begins with its number."""
    day = F.date_format("effective", "MMM d, yyyy")
    link = F.concat(F.lit("[order "), F.col("id").cast("string"), F.lit("](https://x/"), F.col("id").cast("string"), F.lit(")"))
    layout = F.col("customer") % 3
    above = F.concat(day, F.lit("\n\n## order "), F.col("id").cast("string"), F.lit("\nSee "), link, F.lit("\n\n"))
    rows = F.concat(F.lit("# "), day, F.lit("\n| What | Why |\n|--|--|\n| "), link, F.lit(" | "), "severity", F.lit(" |\n"))
    bullets = F.concat(F.lit("## "), F.date_format("effective", "d MMMM yyyy"), F.lit("\n| "), link, F.lit(" |\n"))
    text = F.when(layout == 0, above).when(layout == 1, rows).otherwise(bullets)
    pages = records(spark, sf_dir).groupBy("customer").agg(F.array_join(F.collect_list(text), "").alias("body"))
    pages = pages.select(F.lit("log").alias("source"), F.concat(F.lit("c"), F.col("customer").cast("string")).alias("vendor"), "body")
    return extract.changelog(pages).select("vendor", "date_text", "title", "url")


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_partkey % 5 AS n FROM part)
SELECT k AS p_partkey, b AS signature, x[1]::INTEGER AS line_no, 'cell ' || x[2] || ', line ' || x[3] AS cell, (x[4] + n)::INTEGER AS raw_line FROM p, (SELECT unnest([[2, 2, 2, 8], [5, 3, 2, 12]]) AS x)""")
def notebook_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's brand in the cells of a notebook, and where it stands there and in the file; prose and shell commands don't count."""
    b = F.col("p_brand")
    text = F.concat(
        F.repeat(F.lit("\n"), F.col("p_partkey").cast("int") % 5), F.lit('{\n "cells": [\n  {"cell_type": "markdown", "source": ["use '), b, F.lit('"]},\n  {\n   "cell_type": "code",\n   "source": [\n    "!x '), b, F.lit('\\n",\n    "f(\\"'), b,
        F.lit('\\")\\n",\n    "g"\n   ]\n  },\n  {"source": "a\\n'), b, F.lit('", "outputs": [{"source": "'), b, F.lit('"}], "cell_type": "code"}\n ]\n}\n'),
    )
    notebooks = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit(".ipynb")).alias("path"), F.lit(".ipynb").alias("suffix"), text.alias("text"))
    brands = table(spark, sf_dir, "part").select(b.alias("id"), F.array(b).alias("signatures"), F.lit("rest").alias("kind")).dropDuplicates(["id"])
    hits = tokens.token_hits(code.code_lines(notebooks), tokens.signature_table(brands), ["path", "line_no", "cell", "raw_line"])
    return hits.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("p_partkey"), "signature", "line_no", "cell", "raw_line")


@query("""SELECT s_suppkey AS repo, r AS record_id FROM supplier, (SELECT unnest(['manifest', 'lock', 'both', 'free']) AS r)
WHERE CASE r WHEN 'manifest' THEN s_suppkey % 3 <> 0 AND s_suppkey % 4 = 1 WHEN 'lock' THEN s_suppkey % 3 = 0 WHEN 'both' THEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 ELSE true END""")
def dependency_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as repositories with code, manifests and some lock files; which records' contexts they have."""
    k = F.col("s_suppkey")
    known = table(spark, sf_dir, "supplier").select(k.alias("repo"), F.explode(F.array_compact(F.array(
        F.struct(F.lit("src/a.py").alias("path"), F.when(k % 2 == 0, "import Lib").otherwise("pass").alias("text")),
        F.struct(F.lit("web/package.json").alias("path"), F.concat(F.lit('{"dependencies": {"lib": "^1.'), (k % 4).cast("string"), F.lit('"}}')).alias("text")),
        F.when(k % 3 == 0, F.struct(F.lit("web/package-lock.json").alias("path"), F.concat(F.lit('{"packages": {"node_modules/lib": {"version": "2.0.'), k.cast("string"), F.lit('"}}}')).alias("text"))),
        F.struct(F.lit("node_modules/x/package.json").alias("path"), F.lit('{"dependencies": {"lib": "^9.9"}}').alias("text")),
        F.struct(F.lit("notes.txt").alias("path"), F.lit("import lib dep:npm:lib@1.1").alias("text")),
    ))).alias("f")).select("repo", "f.*")
    contexts = [("manifest", [["dep:npm:lib@1.1"], ["dep:npm:lib@9."]]), ("lock", [["dep:lib@2.0."]]), ("both", [["IMPORT LIB", "dep:lib@2."]]), ("free", None)]
    records_ = spark.createDataFrame(contexts, "id string, repo_context array<array<string>>")
    wanted = sorted({w for _, groups in contexts for g in groups or () for w in g})
    words = tokens.repo_words(code.context_texts(known), wanted)
    hits = known.where("path = 'src/a.py'").select("repo", F.explode(F.array(*[F.lit(i) for i, _ in contexts])).alias("record_id"))
    return tokens.gated(hits, records_, words).select("repo", "record_id")


@query(RECORDS_SQL + """, e AS (SELECT id, vendor, price % 500 + 1 AS k, id % 4 AS form, id % 700 AS u FROM r),
p AS (SELECT p_partkey AS part, 'NATION_' || (p_partkey % 10) AS v FROM part)
SELECT e.id AS key, part AS id FROM e JOIN p ON part = e.u AND (left(vendor, length(v)) = v OR left(v, length(vendor)) = vendor)
UNION SELECT e.id, part FROM e JOIN p ON part = e.k AND (left(vendor, length(v)) = v OR left(v, length(vendor)) = vendor) WHERE form = 0 OR (form = 2 AND part % 3 <> 0 AND part % 4 <> 0)""")
def related_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changelog entries, and the parts of their nations (names may be prefixes) that they name as tokens or share an address with."""
    k = (F.col("price") % 500 + 1).cast("string")
    name = F.concat(F.lit("model-"), k)
    form = F.col("id") % 4
    text = F.when(form == 0, F.concat(name, F.lit(" is Gone"))).when(form == 1, F.concat(name, F.lit("x is gone"))).when(form == 2, F.concat(name, F.lit(" and "), name, F.lit("-old"))).otherwise(F.concat(F.lit("MODEL-"), k, F.lit(" is gone")))
    entries = records(spark, sf_dir).select(F.col("id").alias("key"), "vendor", F.lit("News").alias("title"), text.alias("text"), F.concat(F.lit("https://x/"), (F.col("id") % 700).cast("string"), F.lit("#a")).alias("url"))
    n = F.col("p_partkey")
    model = F.concat(F.lit("model-"), n.cast("string"))
    known = table(spark, sf_dir, "part").select(n.alias("id"), F.concat(F.lit("NATION_"), (n % 10).cast("string")).alias("vendor"), F.array(model).alias("signatures"), F.when(n % 3 == 0, F.array(F.concat(model, F.lit("-old")))).alias("exclude"), F.when(n % 4 == 0, F.array(F.array(F.lit("gone")))).alias("context"))
    urls = known.select("id", F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"))
    return extract.related(entries, known, urls)

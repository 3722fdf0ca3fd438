"""Queries on tool lists: snapshots, their events in words and in public form, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, history, service, snapshot
from .base import Catalog, spread, table

CATALOG = Catalog()
query = CATALOG.query


def _side(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Parts as tools of their brands, before and after some got other sizes, names, titles, hints, outputs and notes."""
    when = lambda n, a, b: F.when((F.col("p_partkey") % n == 0) & F.lit(later), a).otherwise(b)
    none = F.lit(None).cast("string")
    n = when(3, F.col("p_size") + 1, F.col("p_size")).cast("string")
    note = when(13, F.lit(', "description": "a number"'), F.lit(""))
    schema = F.concat(F.lit('{"type": "object", "properties": {"size": {"type": "integer", "enum": ['), n, F.lit("]"), note, F.lit('}, "p'), n, F.lit('": {"type": "string"}}, "required": ["size"]}'))
    name = F.concat("p_name", when(11, F.lit("-x"), F.lit("-")), F.col("p_partkey").cast("string"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), "p_partkey")
    return parts.select(
        F.col("p_brand").alias("server"), name.alias("name"), when(5, F.lit("U"), F.lit("T")).alias("title"), F.col("p_type").alias("description"), schema.alias("input"),
        when(4, F.lit('{"type": "object"}'), none).alias("output"), F.concat(F.lit('{"readOnlyHint": '), when(7, F.lit("true"), F.lit("false")), F.lit("}")).alias("annotations"),
    )


_EVENTS = """t AS (SELECT p_brand AS server, p_partkey AS k, p_name || '-' || p_partkey AS name, p_name || CASE WHEN p_partkey % 11 = 0 THEN '-x' ELSE '-' END || p_partkey AS now, p_size AS n, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS m FROM part),
x AS (SELECT * FROM t WHERE k % 11 = 0), y AS (SELECT * FROM t WHERE k % 11 <> 0),
e AS (SELECT server, name, 'tool:' || name AS path, 'removed' AS change, 'breaking' AS severity, name AS before, NULL::VARCHAR AS after FROM x
  UNION ALL SELECT server, now, 'tool:' || now, 'added', 'additive', NULL, now FROM x
  UNION ALL SELECT a.server, a.name, 'tool:' || a.name, 'possible_rename', 'info', a.name, min(b.now) FROM x a JOIN x b ON a.server = b.server AND a.n = b.m GROUP BY a.server, a.name HAVING count(*) = 1
  UNION ALL SELECT server, name, 'tool:' || name || '.input.size', 'enum_values_removed', 'breaking', '[' || n || ']', NULL FROM y WHERE n <> m
  UNION ALL SELECT server, name, 'tool:' || name || '.input.size', 'enum_values_added', 'additive', NULL, '[' || m || ']' FROM y WHERE n <> m
  UNION ALL SELECT server, name, 'tool:' || name || '.input.p' || n, 'removed', 'breaking', 'string', NULL FROM y WHERE n <> m
  UNION ALL SELECT server, name, 'tool:' || name || '.input.p' || m, 'added', 'additive', NULL, 'string' FROM y WHERE n <> m
  UNION ALL SELECT server, name, 'tool:' || name || '.title', 'title_changed', 'info', 'T', 'U' FROM y WHERE k % 5 = 0
  UNION ALL SELECT server, name, 'tool:' || name || '.annotations.readOnlyHint', 'annotation_changed', 'info', 'false', 'true' FROM y WHERE k % 7 = 0
  UNION ALL SELECT server, name, 'tool:' || name || '.output', 'added', 'additive', NULL, 'object' FROM y WHERE k % 4 = 0
  UNION ALL SELECT server, name, 'tool:' || name, 'changed_unclassified', 'info', NULL, NULL FROM y WHERE k % 13 = 0 AND n = m AND k % 5 <> 0 AND k % 7 <> 0 AND k % 4 <> 0)"""


@query(f"WITH {_EVENTS} SELECT * FROM e")
def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.tool_events(_side(spark, sf_dir, False), _side(spark, sf_dir, True))


@query(f"""WITH {_EVENTS} SELECT name, count(*) FILTER (severity = 'breaking')::BIGINT AS breaking, count(*) FILTER (severity = 'silent')::BIGINT AS silent, count(*) FILTER (severity = 'additive')::BIGINT AS additive, count(*) FILTER (severity = 'info')::BIGINT AS info
FROM e WHERE change <> 'title_changed' GROUP BY name""")
def change_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each severity a tool's change has, texts aside."""
    return service.change_summary(tool_events(spark, sf_dir), "name").select("name", "breaking", "silent", "additive", "info")


@query(f"""WITH {_EVENTS} SELECT server, name, path, CASE change WHEN 'removed' THEN CASE WHEN path = 'tool:' || name THEN 'Tool removed' ELSE 'Parameter removed' END
  WHEN 'added' THEN CASE WHEN path = 'tool:' || name THEN 'Tool added' WHEN ends_with(path, '.output') THEN 'Output field added' ELSE 'Optional parameter added' END
  WHEN 'possible_rename' THEN 'Possibly renamed (an added tool shares most of its parameters)' WHEN 'enum_values_removed' THEN 'Allowed values removed' WHEN 'enum_values_added' THEN 'Allowed values added'
  WHEN 'title_changed' THEN 'Title changed' WHEN 'annotation_changed' THEN 'Annotation changed' ELSE 'Changed in a way the probe does not classify yet (for example a parameter description)' END AS words FROM e""")
def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_events(spark, sf_dir).select("server", "name", "path", diff.event_words(F.col("change"), F.col("path"), F.col("name")).alias("words"))


@query(f"""WITH {_EVENTS}, h AS (SELECT *, CASE WHEN regexp_full_match(name, '[A-Za-z0-9_.\\-/]{{1,128}}') THEN name ELSE 'sha256:' || sha256(name) END AS safe FROM e)
SELECT server, safe AS name, 'tool:' || safe || substr(path, length(name) + 6) AS path, change, severity, CASE WHEN change = 'title_changed' THEN 1 END::INTEGER AS old_len, CASE WHEN change = 'title_changed' THEN 1 END::INTEGER AS new_len,
  CASE WHEN change = 'title_changed' THEN sha256('T') END AS old_sha256, CASE WHEN change = 'title_changed' THEN sha256('U') END AS new_sha256 FROM h""")
def public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without anybody's texts."""
    return diff.public_events(tool_events(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as servers, their turns as versions of a tool; two of three turns have something put in."""
    extra = F.element_at(F.array(F.lit(" Mention it."), F.lit(" DON\u2019T\n mention it."), F.lit(" Sys\u200btem  prompts.")), F.col("turn").cast("int") % 3 + 1)
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select(F.col("conv_id").alias("server"), F.col("turn").alias("name"), F.concat("text", extra).alias("text"))


@query("""SELECT conv_id AS server, turn AS name, 'instruction_like_text' AS flag, CASE turn % 3 WHEN 1 THEN 'don''t mention' ELSE 'system prompt' END AS detail FROM conversations WHERE turn % 3 <> 0 AND text IS NOT NULL
UNION ALL SELECT conv_id, turn, 'hidden_characters', 'U+200B' FROM conversations WHERE turn % 3 = 2 AND text IS NOT NULL""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and invisible characters that a conversation's text has gained from one turn to the next."""
    turns = _turns(spark, sf_dir)
    return history.new_flags(turns.withColumn("name", F.col("name") + 1), turns)


@query("""WITH t AS (SELECT p_brand AS server, p_partkey AS k, p_name || CASE WHEN p_partkey % 11 = 0 THEN '-x' ELSE '-' END || p_partkey AS name FROM part)
SELECT server, name, 'annotation_widened' AS flag, 'destructiveHint false to true' AS detail FROM t WHERE k % 7 = 0 AND k % 11 <> 0
UNION ALL SELECT server, name, 'description_changed', '' FROM t WHERE k % 5 = 0 AND k % 11 <> 0
UNION ALL SELECT server, name, 'instruction_like_text', '.env' FROM t WHERE k % 5 = 0
UNION ALL SELECT server, name, 'unusual_tool_name', '' FROM t WHERE k % 11 = 0 AND NOT regexp_full_match(name, '[A-Za-z0-9_./-]{1,128}')""")
def tool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is worth a look in the tools of ``tool_events``, some of which delete, or say that they read a settings file."""
    sides = []
    for later in (False, True):
        deletes = F.when((F.col("k") % 7 == 0) & F.lit(later), "true").otherwise("false")
        reads = F.when((F.col("k") % 5 == 0) & F.lit(later), F.lit("Reads .env files")).otherwise(F.col("description"))
        rows = _side(spark, sf_dir, later).withColumn("k", F.regexp_extract("name", "[0-9]+$", 0).cast("long"))
        rows = rows.withColumns({"title": F.lit("T"), "annotations": F.concat(F.lit('{"destructiveHint": '), deletes, F.lit("}")), "description": reads})
        sides.append(rows.drop("k"))
    return history.tool_flags(*sides)


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as servers: lists of two tools, some of which can't be read."""
    key = F.col("s_suppkey").cast("string")
    tool: Column = F.concat(F.lit('{"name": "b'), key, F.lit('", "icon": 1, "inputSchema": {"type": "object", "required": ["y", "x"], "properties": {"y": true, "x": {"type": "string"}}}}'))
    bad = F.when(F.col("s_suppkey") % 7 == 0, F.lit('{"title": "nameless"}')).when(F.col("s_suppkey") % 5 == 0, F.lit('{"name": "a", "annotations": []}')).otherwise(F.lit('{"name": "a"}'))
    body = F.when(F.col("s_suppkey") % 11 == 0, F.lit("<html>")).otherwise(F.concat(F.lit('{"server": {"version": "1.'), key, F.lit('"}, "tools": ['), tool, F.lit(", "), bad, F.lit("]}")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server"), body.alias("body"))


@query("""WITH s AS (SELECT s_suppkey AS server, CASE WHEN s_suppkey % 11 = 0 THEN 'invalid response' WHEN s_suppkey % 7 = 0 THEN 'a tool without a name' WHEN s_suppkey % 5 = 0 THEN 'annotations is not an object' END AS error FROM supplier)
SELECT server, error, CASE WHEN error IS NULL THEN '1.' || server END AS version, CASE WHEN error IS NULL THEN 'a,b' || server END AS names,
  CASE WHEN error IS NULL THEN sha256('[{"name":"a"},{"inputSchema":{"properties":{"x":{"type":"string"},"y":{}},"required":["x","y"],"type":"object"},"name":"b' || server || '"}]') END AS hash FROM s""")
def tool_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool lists in one form, with a hash, or why they can't be read."""
    return snapshot.snapshots(_fetched(spark, sf_dir)).select("server", "error", "version", F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("names"), "hash")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0)
SELECT k AS server, 'server.version' AS path, 'version_changed' AS change, 'info' AS severity, '1.' || k AS before, '2.' || k AS after FROM s WHERE k % 2 = 0
UNION ALL SELECT k, 'tool:a', 'removed', 'breaking', 'a', NULL FROM s WHERE k % 2 = 0 UNION ALL SELECT k, 'tool:c', 'added', 'additive', NULL, 'c' FROM s WHERE k % 2 = 0""")
def baseline_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servers against their baselines: every other one has a new version and another name for a tool; a third have no baseline."""
    fetched = _fetched(spark, sf_dir)
    moved = F.when(F.col("server") % 2 == 0, F.replace(F.replace("body", F.lit('"name": "a"'), F.lit('"name": "c"')), F.lit('"1.'), F.lit('"2.'))).otherwise(F.col("body"))
    before, after = snapshot.snapshots(fetched), snapshot.snapshots(fetched.withColumn("body", moved))
    events = diff.tool_events(*snapshot.probe(before, after)).drop("name")
    return events.unionByName(diff.server_events(before.where("error is null"), after.where("error is null")))


@query("SELECT count(*)::BIGINT AS checked, count(*) FILTER (s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 5 = 0)::BIGINT AS failed, 0::INTEGER AS code FROM supplier")
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many servers were checked and failed, and whether the run did."""
    read = snapshot.snapshots(_fetched(spark, sf_dir))
    return history.run_outcome(read.select(F.col("error").isNull().alias("ok")))


@query("SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' Mention it.' WHEN 1 THEN ' DON\u2019T' || chr(10) || ' mention it.' ELSE ' Sys<U+200B>tem  prompts.' END AS shown FROM conversations")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their invisible characters shown."""
    rows = _turns(spark, sf_dir)
    return rows.select(F.col("server").alias("conv_id"), F.col("name").alias("turn"), history.visible(F.col("text")).alias("shown"))

"""Queries on snapshots and observations: diffs, histories, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import diff, history
from ..streaming.observe import observe
from .base import Catalog, table

CATALOG = Catalog()
query = CATALOG.query
#: The snapshot before ends with the first day, the one after begins with the second.
ENDS, BEGINS = "1995-03-01", "2001-08-01"
_SIDES = f"a AS (SELECT DISTINCT l_partkey AS tool, l_suppkey AS param FROM lineitem WHERE l_shipdate < DATE '{ENDS}'), b AS (SELECT DISTINCT l_partkey AS tool, l_suppkey AS param FROM lineitem WHERE l_shipdate >= DATE '{BEGINS}')"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tools (parts) with parameters (suppliers) in two snapshots of what was shipped."""
    rows = table(spark, sf_dir, "lineitem")
    pairs = lambda when: rows.where(when).select(F.col("l_partkey").alias("tool"), F.col("l_suppkey").alias("param")).distinct()
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return pairs(F.col("l_shipdate") < day(ENDS)), pairs(F.col("l_shipdate") >= day(BEGINS))


@query(f"WITH {_SIDES}, x AS (SELECT DISTINCT tool FROM a), y AS (SELECT DISTINCT tool FROM b) SELECT coalesce(x.tool, y.tool) AS tool, CASE WHEN y.tool IS NULL THEN 'removed' ELSE 'added' END AS change FROM x FULL JOIN y ON x.tool = y.tool WHERE x.tool IS NULL OR y.tool IS NULL")
def surface_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.set_diff(*sides(spark, sf_dir), ["tool"])


@query(f"""WITH {_SIDES}, c AS (SELECT DISTINCT tool FROM a SEMI JOIN b USING (tool)), d AS (
  (SELECT tool, param, 'removed' AS change, 'breaking' AS severity FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT tool, param, 'added', 'additive' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)))
SELECT d.* FROM d SEMI JOIN c USING (tool)""")
def param_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.param_changes(*sides(spark, sf_dir), "tool", "param")


_RENAMED = "a AS (SELECT DISTINCT l_orderkey % 900 AS tool, l_suppkey % 40 AS param FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_orderkey % 900 + 300 AS tool, l_suppkey % 40 AS param FROM lineitem WHERE l_linenumber > 2)"


@query(f"""WITH {_RENAMED}, g AS (SELECT * FROM a ANTI JOIN b USING (tool)), n AS (SELECT * FROM b ANTI JOIN a USING (tool)),
gl AS (SELECT tool, list(param) AS p FROM g GROUP BY tool), nl AS (SELECT tool, list(param) AS p FROM n GROUP BY tool),
m AS (SELECT gl.tool AS old, nl.tool AS new, len(list_intersect(gl.p, nl.p)) / len(list_distinct(list_concat(gl.p, nl.p))) AS similarity FROM gl, nl)
SELECT old, min(new) AS new, min(similarity) AS similarity FROM m WHERE similarity >= 0.5 GROUP BY old HAVING count(*) = 1""")
def likely_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    param = (F.col("l_suppkey") % 40).alias("param")
    before = rows.where("l_linenumber <= 2").select((F.col("l_orderkey") % 900).alias("tool"), param).distinct()
    after = rows.where("l_linenumber > 2").select((F.col("l_orderkey") % 900 + 300).alias("tool"), param).distinct()
    return diff.likely_renames(before, after, "tool", "param")


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of each event's properties; some events have a list or a null instead of a number."""
    body = F.when(F.col("event_id") % 7 == 0, F.replace("props", F.lit('"k": '), F.lit('"k": null, "v": '))).when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"k": [1, 2.5, "x"], "o": '), "props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.inline(diff.schema_paths(body)))


_PATH_SQL = """p AS (
  SELECT event_id, '$' AS path, 'object' AS type, false AS nullable FROM events
  UNION ALL SELECT event_id, '$.k', CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_id % 11 = 0 THEN 'array' ELSE 'integer' END, event_id % 7 = 0 FROM events
  UNION ALL SELECT event_id, '$.v', 'integer', false FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT event_id, x[1], x[2], false FROM (SELECT event_id, unnest([['$.k[]', 'integer|number|string'], ['$.o', 'object'], ['$.o.k', 'integer']]) AS x FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 0))"""


@query(f"WITH {_PATH_SQL} SELECT event_id, path, type, nullable FROM p")
def schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_paths(spark, sf_dir).select("event_id", "path", "type", "nullable")


@query(f"""WITH {_PATH_SQL}, a AS (SELECT event_id // 2 AS pair, path, type AS t0, nullable AS n0 FROM p WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 AS pair, path, type AS t1, nullable AS n1 FROM p WHERE event_id % 2 = 1),
f AS (SELECT pair, path, t0, t1, CASE WHEN t1 IS NULL THEN 'removed' WHEN t0 IS NULL THEN 'added' WHEN t0 <> t1 THEN 'type_changed' WHEN n1 AND NOT n0 THEN 'became_nullable' END AS change FROM a FULL JOIN b USING (pair, path)),
e AS (SELECT * FROM f WHERE change IS NOT NULL)
SELECT pair, path, change, t0 AS before, t1 AS after, CASE WHEN change = 'removed' THEN 'breaking' WHEN change = 'added' THEN 'additive' WHEN change = 'type_changed' AND t0 <> 'null' AND t1 <> 'null' THEN 'breaking' ELSE 'silent' END AS severity
FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.pair = e.pair AND x.change <> 'became_nullable' AND (starts_with(e.path, x.path || '.') OR starts_with(e.path, x.path || '[')))""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd event's shape against that of the event before."""
    rows = event_paths(spark, sf_dir).withColumn("pair", F.expr("event_id div 2"))
    return diff.shape_events(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["pair"])


def observations(events: DataFrame) -> DataFrame:
    """Events as observations: errors are failures, other types what was seen."""
    failed = F.col("event_type") == "error"
    return events.select("user_id", "ts", F.when(failed, F.when(F.col("event_id") % 3 == 0, "auth").otherwise("error")).otherwise("ok").alias("outcome"), F.when(~failed, F.col("event_type")).alias("hash"), F.lit(1).alias("tools"))


def _shown(rows: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("user_id", "kind", day("date"), day("confirmed_at"), "from_hash", "to_hash")


_MACHINE = """WITH RECURSIVE o AS (SELECT user_id, ts, event_type AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type <> 'error'),
m AS (SELECT user_id, i, h AS cur, CAST(NULL AS VARCHAR) AS pend, CAST(NULL AS TIMESTAMP) AS since, 'first_seen' AS kind, ts AS date, ts AS confirmed_at, CAST(NULL AS VARCHAR) AS from_hash, h AS to_hash FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN o.h = m.pend THEN o.h ELSE m.cur END, CASE WHEN o.h = m.cur OR o.h = m.pend THEN NULL ELSE o.h END, CASE WHEN o.h = m.cur OR o.h = m.pend THEN NULL ELSE o.ts END,
    CASE WHEN o.h = m.pend THEN 'change' END, CASE WHEN o.h = m.pend THEN m.since END, CASE WHEN o.h = m.pend THEN o.ts END, CASE WHEN o.h = m.pend THEN m.cur END, CASE WHEN o.h = m.pend THEN o.h END
  FROM m JOIN o ON o.user_id = m.user_id AND o.i = m.i + 1)
SELECT user_id, kind, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, strftime(confirmed_at, '%Y-%m-%d %H:%M:%S') AS confirmed_at, from_hash, to_hash FROM m WHERE kind IS NOT NULL"""


@query(_MACHINE)
def confirmed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(history.replay(observations(table(spark, sf_dir, "events")), "user_id").where("kind != 'unstable'"))


@query(_MACHINE)
def confirmed_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the table's files, until it has caught up."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file or a folder
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    out = f"{base.rstrip('/')}/observed-{uuid.uuid4().hex}"
    run = observe(observations(stream), "user_id").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return _shown(spark.read.parquet(f"{out}/rows").where("kind != 'unstable'"))


@query("""WITH RECURSIVE o AS (SELECT user_id, ts, event_type AS h, 'v' || event_id % 4 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type <> 'error'),
m AS (SELECT user_id, i, h AS cur, p AS protocol, ts AS since, CAST(NULL AS VARCHAR) AS pend, CAST(NULL AS TIMESTAMP) AS pend_since FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN o.h = m.pend THEN o.h ELSE m.cur END, CASE WHEN o.h = m.cur OR o.h = m.pend THEN o.p ELSE m.protocol END, CASE WHEN o.h = m.pend THEN o.ts ELSE m.since END,
    CASE WHEN o.h = m.cur OR o.h = m.pend THEN NULL ELSE o.h END, CASE WHEN o.h = m.cur OR o.h = m.pend THEN NULL ELSE o.ts END FROM m JOIN o ON o.user_id = m.user_id AND o.i = m.i + 1),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1),
a AS (SELECT user_id, max(ts) AS last_checked, max(ts) FILTER (event_type <> 'error') AS last_ok FROM events GROUP BY user_id)
SELECT user_id, cur AS hash, protocol, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, pend AS pending, strftime(pend_since, '%Y-%m-%d %H:%M:%S') AS pending_since, strftime(last_checked, '%Y-%m-%d %H:%M:%S') AS last_checked, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok
FROM a LEFT JOIN l USING (user_id)""")
def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each user after the last event; the protocol of an event says nothing of a change."""
    events = table(spark, sf_dir, "events")
    seen = observations(events).join(events.select("user_id", "ts", F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("protocol")), ["user_id", "ts"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return history.current(seen, "user_id").select("user_id", "hash", "protocol", day("since"), "pending", day("pending_since"), day("last_checked"), day("last_ok"))


@query("""WITH c AS (SELECT user_id, ts, event_type AS h, lag(event_type) OVER w AS b, coalesce(epoch_us(lead(ts) OVER w) - epoch_us(ts), 8) // 2 AS half FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, 'change' AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, strftime(ts + to_microseconds(half), '%Y-%m-%d %H:%M:%S') AS confirmed_at, b AS from_hash, h AS to_hash FROM c WHERE b IS NOT NULL AND b <> h""")
def settled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn from one type of event to another, recorded three times before the next event by runs that died before they were through."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = observations(table(spark, sf_dir, "events")).where("outcome = 'ok'").select("user_id", "hash", micros.alias("at"))
    order = Window.partitionBy("user_id").orderBy("at")
    turns = seen.select("user_id", "at", F.col("hash").alias("to_hash"), F.lag("hash").over(order).alias("from_hash"), F.coalesce(F.lead("at").over(order) - F.col("at"), F.lit(8)).alias("gap")).where("from_hash != to_hash")
    again = turns.select("*", F.explode(F.array(F.lit(0).cast("long"), F.expr("gap div 4"), F.expr("gap div 2"))).alias("late"))
    # the second of the three dates itself by its own run
    date = F.when(F.col("late") == F.expr("gap div 4"), F.col("at") + F.col("late")).otherwise(F.col("at"))
    rows = again.select("user_id", F.lit("change").alias("kind"), F.timestamp_micros(date).alias("date"), F.timestamp_micros(F.col("at") + F.col("late")).alias("confirmed_at"), "from_hash", "to_hash", F.lit(None).cast("array<string>").alias("hashes"))
    return _shown(history.settled(rows, "user_id"))


@query("""WITH RECURSIVE o AS (SELECT user_id, ts, event_type AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type <> 'error'),
m AS (SELECT user_id, i, ts, h AS cur, CAST(NULL AS VARCHAR) AS pend, CAST(NULL AS VARCHAR) AS left_from, CAST(NULL AS VARCHAR) AS a, h AS b FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.ts, CASE WHEN o.h = m.pend THEN o.h ELSE m.cur END, CASE WHEN o.h = m.cur OR o.h = m.pend THEN NULL ELSE o.h END, CASE WHEN o.h = m.pend THEN m.cur ELSE m.left_from END,
    CASE WHEN o.h = m.pend THEN CASE WHEN m.left_from = o.h THEN m.cur END ELSE m.pend END, o.h
  FROM m JOIN o ON o.user_id = m.user_id AND o.i = m.i + 1)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, least(a, b) || ',' || greatest(a, b) AS pair FROM m WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, least(a, b), greatest(a, b) ORDER BY ts) = 2""")
def unstable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.replay(observations(table(spark, sf_dir, "events")), "user_id").where("kind = 'unstable'")
    return rows.select("user_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.array_join("hashes", ",").alias("pair"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 3 = 0 THEN 'kind' ELSE 'failure' END AS g FROM events),
n AS (SELECT *, CASE WHEN lag(g) OVER w = g THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM n)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*)::BIGINT AS failures FROM r WHERE g <> 'ok' GROUP BY user_id, run""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.streaks(observations(table(spark, sf_dir, "events")), "user_id")
    return rows.select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "failures")


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS flags FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' - 5 AND DATE '2024-01-10' GROUP BY user_id")
def open_flags_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("date"), F.col("event_type").alias("flag"))
    return history.open_flags(rows, "user_id", "2024-01-10", 5)


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 5 = 0)")
def seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return history.unseen(events.where("event_type = 'purchase'").select("user_id"), events.where("event_type = 'error' and event_id % 5 = 0"), "user_id")


@query("""WITH s AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'auth' ELSE 'error' END ELSE 'ok' END, ts) AS outcome FROM events WHERE user_id % 5 <> 0 GROUP BY user_id)
SELECT user_id, CASE WHEN outcome IS NULL THEN 'pending_first_check' WHEN outcome = 'ok' THEN 'ok' WHEN outcome = 'auth' THEN 'needs_login' ELSE 'failing' END AS status FROM s LEFT JOIN l USING (user_id)""")
def server_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = observations(events.where("user_id % 5 != 0")).groupBy("user_id").agg(F.max_by("outcome", "ts").alias("outcome"))
    return history.status(events.select("user_id").distinct(), last, "user_id").select("user_id", "status")

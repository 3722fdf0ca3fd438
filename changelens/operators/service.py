"""The read-only questions that the feed answers; each takes tables and parameters and returns rows.

Parameters are checked at the door: a wrong one is a ValueError, never an empty answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import feed, history, scan, tokens

MAX_ROWS, MAX_ASKED, MAX_DAYS = 50, 100, 365


def _number(name: str, value: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"{name} must be a number from 1 to {most}")
    return value


def same_vendor(vendor: Column, asked: str) -> Column:
    """By name without regard to case, or by its slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(vendor), r"[^\p{L}\p{N}]+", "-"), r"\A-+|-+\z", "")
    return (F.lower(vendor) == asked.lower()) | (slug == asked.lower())


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def naming(records: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, record columns): records that an asked text names, by the rule by which code is scanned.

    A signature stands in the text as a token; a model's without regard to case, also as a snapshot or as a variant that
    the record's prose names. Longer signatures come first and what they cover is taken; what an exclude covers, or a text that
    goes on as an exclude does, white space aside, names nothing, nor does a model's id in a partner's form alone. Null texts name nothing.
    """
    model = F.col("kind") == "model"
    texts = lambda c: F.coalesce(_column(records, c, "array<string>"), F.array().cast("array<string>"))
    own = lambda c: F.array_distinct(F.filter(F.transform(texts(c), lambda x: F.when(model, F.lower(x)).otherwise(x)), lambda x: x != ""))
    prose = F.concat_ws(" ", *[_column(records, c) for c in ("summary", "detail", "surface")])
    named = F.when(model, scan.record_names(prose)).otherwise(F.array().cast("array<string>"))
    known = records.select(F.col("id").alias("record_id"), _column(records, "vendor").alias("vendor"), F.coalesce(model, F.lit(False)).alias("model"), own("signatures").alias("_own"), own("exclude").alias("_excludes"), named.alias("named"))
    signatures = known.select("record_id", "vendor", "model", "_excludes", "named", F.posexplode("_own").alias("_order", "signature"), F.lit(False).alias("_out"))
    excludes = known.select("record_id", "vendor", "model", "_excludes", "named", F.explode("_excludes").alias("signature")).withColumns({"_order": F.lit(0), "_out": F.lit(True)})
    wanted = signatures.unionByName(excludes).withColumns({"written": F.col("signature"), "word": tokens.longest_word(F.col("signature"))})
    lines = asked.select("asked").where("asked is not null").distinct()
    # forms are looked for once, however many records share them; records come in afterwards
    forms = wanted.select("model", "written", "word", "named").distinct()
    few = forms.select("written").distinct().limit(tokens.SCAN_ROWS + 1).count() <= tokens.SCAN_ROWS
    written = sorted(r.written for r in forms.select("written").distinct().collect()) if few else []

    def side(is_model: bool, line: Column) -> DataFrame:
        texts, mine = lines.withColumn("line", line), forms.where(F.col("model") == F.lit(is_model))
        if few:
            return texts.select("asked", "line", F.explode(tokens.held(F.col("line"), written)).alias("written")).join(mine.drop("word"), "written")
        return tokens.candidates(texts, mine, ["asked"])

    at = side(True, F.lower("asked")).unionByName(side(False, F.col("asked")), allowMissingColumns=True)
    at = at.withColumn("start", F.explode(tokens.positions(F.col("line"), F.col("written"), F.col("model"), F.col("named"))))
    at = at.withColumn("stop", F.col("start") + F.char_length("written"))
    hits = at.select("asked", "line", "model", "written", "named", "start", "stop").join(wanted.drop("word"), ["model", "written", "named"])
    partner = F.lit(False)
    for name, form in scan.PARTNERS.items():
        partner = partner | F.coalesce(F.col("model") & (F.col("vendor") == name) & F.substr("line", F.col("stop") + 1).rlike(form), F.lit(False))
    flat = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    goes_on = F.exists(F.filter(F.transform("_excludes", flat), lambda e: e.startswith(F.col("signature"))), lambda e: flat(F.substr("line", F.col("start") + 1)).startswith(e))
    # a text's hits of one record are as many as the text has places at most, times the record's signatures
    hit = F.struct((-F.char_length("signature")).alias("size"), F.col("_order").alias("order"), "start", "stop", "signature", goes_on.alias("goes_on"), partner.alias("partner"))
    found = hits.groupBy("asked", "record_id").agg(F.array_sort(F.collect_list(F.when(~F.col("_out"), hit))).alias("_hits"), F.collect_list(F.when(F.col("_out"), F.struct("start", "stop"))).alias("_spans"))
    free = F.filter("_hits", lambda h: ~h["goes_on"] & ~F.exists("_spans", lambda x: (x["start"] <= h["start"]) & (x["stop"] >= h["stop"])))
    taken = lambda acc, h: F.exists(acc, lambda x: (x["signature"] != h["signature"]) & (x["start"] < h["stop"]) & (h["start"] < x["stop"]))
    kept = F.aggregate(free, F.filter("_hits", lambda h: F.lit(False)), lambda acc, h: F.when(taken(acc, h), acc).otherwise(F.concat(acc, F.array(h))))
    ours = F.filter(kept, lambda h: F.exists("_hits", lambda x: (x["signature"] == h["signature"]) & ~x["partner"]))
    pairs = found.where(F.size(ours) > 0).select("asked", F.col("record_id").alias("id"))
    return records.join(pairs, "id").select("asked", *records.columns)


def check_identifiers(records: DataFrame, asked: DataFrame, today: str) -> DataFrame:
    """A row for each identifier: how many records name it, the one that leads, and an answer in words."""
    found = naming(records, asked)
    first = feed.lead(found, ["asked"], today).select("asked", "id", "effective", "severity", "kind")
    counts = found.groupBy("asked").agg(F.count("*").alias("records"))
    out = asked.select("asked").distinct().join(counts, "asked", "left").join(first, "asked", "left")
    day = F.date_format("effective", "MMM d, yyyy")
    what = F.when(F.col("severity") == "breaking", F.when(F.col("kind") == "model", "is shut down").otherwise("breaks")).when(F.col("severity") == "deprecation", "is deprecated").otherwise("changes")
    ahead = F.col("effective") > F.lit(today).cast("date")
    words = F.when(F.col("id").isNull(), F.concat(F.col("asked"), F.lit(": no change on record"))).otherwise(F.concat("asked", F.lit(" "), what, F.when(F.col("effective") == F.lit(today).cast("date"), " today, ").when(ahead, " on ").otherwise(" since "), day))
    return out.select("asked", F.coalesce("records", F.lit(0)).alias("records"), "id", "effective", "severity", words.alias("answer"))


def check_models(records: DataFrame, asked: Sequence[str], today: str) -> DataFrame:
    if not 1 <= len(asked) <= MAX_ASKED:
        raise ValueError(f"from 1 to {MAX_ASKED} identifiers")
    return check_identifiers(records, records.sparkSession.createDataFrame([(a,) for a in asked], "asked string"), today)


def list_upcoming(records: DataFrame, today: str, days: int = 90, vendor: str | None = None) -> DataFrame:
    rows = records if vendor is None else records.where(same_vendor(F.col("vendor"), vendor))
    return feed.upcoming(rows, today, _number("days", days, MAX_DAYS), MAX_ROWS)


def vendors_instead(records: DataFrame, vendor: str) -> DataFrame:
    """All vendors, if none is the one asked for; nothing otherwise."""
    known = records.select("vendor", same_vendor(F.col("vendor"), vendor).alias("same"))
    return known.groupBy().agg(F.bool_or("same").alias("any"), F.array_sort(F.collect_set("vendor")).alias("vendors")).where("not any").select(F.explode("vendors").alias("vendor"))


def search_changes(records: DataFrame, text: str, vendor: str | None = None, limit: int = 20) -> DataFrame:
    if not text.strip():
        raise ValueError("nothing to search for")
    return feed.search(records, text, vendor, _number("limit", limit, MAX_ROWS))


def get_record(records: DataFrame, id_: str) -> DataFrame:
    return records.where(F.col("id") == id_)


def list_servers(servers: DataFrame, changes: DataFrame, last: DataFrame, key: str = "slug") -> DataFrame:
    """Watched servers with their status, their changes and when the last one was."""
    return history.status(servers, last, key).join(history.summary(changes, key), key, "left").withColumn("changes", F.coalesce("changes", F.lit(0)))


def server_changes(servers: DataFrame, changes: DataFrame, asked: str, today: str, days: int = 90) -> DataFrame:
    """A server's changes of the last days, the newest first."""
    found = history.find_server(servers, servers.sparkSession.createDataFrame([(asked,)], "asked string"))
    rows = changes.join(F.broadcast(found.select("slug")), "slug").where("kind = 'change'")  # one row
    first = F.date_sub(F.lit(today).cast("date"), _number("days", days, MAX_DAYS) - 1)
    return rows.where(F.col("date").cast("date").between(first, F.lit(today).cast("date"))).orderBy(F.desc("date"))


def change_summary(events: DataFrame, key: str, shown: int = 3) -> DataFrame:
    """What a change is about: events by severity (texts aside), and the first few by path."""
    rows = events.where(~F.col("path").rlike(r"\.(?:title|description)\z"))
    counts = {s: F.count_if(F.col("severity") == s).alias(s) for s in ("breaking", "silent", "additive", "info")}
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("path", "change"))), 1, shown), lambda x: F.concat_ws(" ", x.change, x.path))
    return rows.groupBy(key).agg(*counts.values(), first.alias("first"))

"""A history as documents: flat entries, events and flags nested below their server, in pages of bounded size.

Entries are numbered over the whole table by ranges (``ranks.placed``), so that a server with very many of
them is spread over pages, and no task ever holds more than a page of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_path, safe_tool
from ..schemas import SEVERITIES, rank
from .history import open_flags, status
from .ranks import placed
from .served import TEXT_EVENTS

PAGE = 1000


def nested_entries(entries: DataFrame, events: DataFrame, flags: DataFrame) -> DataFrame:
    """(slug, at, date, kind, tool_count, counts, events, flags, hashes): each entry with what its check found.

    entries (slug, at, date, kind, tool_count, hashes): ``at`` is the check's stamp; a check has one entry of a kind. Events
    (slug, at, type, tool, path, severity, old_len, new_len, old_sha256, new_sha256) go to changes, the worst first, flags (slug, at, flag,
    tool, detail) to changes and first sights; names and paths are put in safe form. Other kinds have null there.
    """
    by = ["slug", "at"]
    said = F.col("type").isin(*TEXT_EVENTS)
    sizes = [F.when(said, F.col(c)).alias(c) for c in ("old_len", "new_len", "old_sha256", "new_sha256")]
    public = F.struct(F.coalesce(rank(F.col("severity")), F.lit(len(SEVERITIES))).alias("rank"), safe_path(F.col("path"), F.col("tool")).alias("path"), "type", safe_tool(F.col("tool")).alias("tool"), "severity", *sizes)
    shown = F.transform(F.array_sort(F.collect_list(public)), lambda e: e.dropFields("rank"))
    found = events.groupBy(*by).agg(shown.alias("_events"), *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in SEVERITIES])
    raised = flags.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("flag", safe_tool(F.col("tool")).alias("tool"), F.coalesce("detail", F.lit("")).alias("detail")))).alias("_flags"))
    rows = entries.select("slug", "at", "date", "kind", "tool_count", "hashes").join(found, by, "left").join(raised, by, "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    change = F.col("kind") == "change"
    counts = F.struct(*[F.coalesce(f"_{s}", F.lit(0)).cast("long").alias(s) for s in SEVERITIES])
    return rows.select(
        "slug", "at", "date", "kind",
        F.when(F.col("kind") == "first_seen", F.col("tool_count")).alias("tool_count"),
        F.when(change, counts).alias("counts"), F.when(change, none("_events")).alias("events"),
        F.when(F.col("kind").isin("change", "first_seen"), none("_flags")).alias("flags"),
        F.when(F.col("kind") == "unstable", F.col("hashes")).alias("hashes"),
    )


def paged(entries: DataFrame, size: int = PAGE, newest: bool = True) -> DataFrame:
    """(slug, page, entries): a server's entries in the order of their stamps, ``size`` on a page (from 1). Entries of one stamp stand as change, first sight, unstable pair."""
    at = F.col("at").desc() if newest else F.col("at").asc()
    rows = placed(entries.where("slug is not null"), [F.col("slug"), at, F.col("kind")], "_place")
    first = rows.groupBy("slug").agg(F.min("_place").alias("_first"))
    rows = rows.join(first, "slug").withColumn("page", (F.expr(f"(_place - _first) div {int(size)}") + 1).cast("int"))
    row = F.struct("_place", F.struct("date", "kind", "tool_count", "counts", "events", "flags", "hashes").alias("entry"))
    return rows.groupBy("slug", "page").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["entry"]).alias("entries"))


def history_documents(servers: DataFrame, entries: DataFrame, events: DataFrame, flags: DataFrame, last: DataFrame, today: str, base: str, days: int = 30, size: int = PAGE, newest: bool = True) -> DataFrame:
    """(slug, page, pages, name, url, registry_name, added, status, status_since, tool_count, last_checked, last_ok, first_seen, last_change, open_flags, page_url, entries).

    One row a server, or one for each ``size`` entries of it. servers (slug, name, url, registry_name, added) are all shown, also without
    an entry (one page of none); entries of other servers aren't. last (slug, outcome, status_since, tool_count, last_checked, last_ok) is
    the state after the last check. ``status_since`` is only shown while checks fail.
    """
    date = lambda kind: F.when(F.col("kind") == kind, F.col("date"))
    sums = entries.groupBy("slug").agg(F.min(date("first_seen")).alias("first_seen"), F.max(date("change")).alias("last_change"))
    noted = entries.where("kind != 'unstable'").select("slug", "at", "date")
    open_ = open_flags(flags.join(noted, ["slug", "at"]), "slug", today, days).withColumnRenamed("flags", "open_flags")
    pages = paged(nested_entries(entries.join(servers.select("slug"), "slug", "left_semi"), events, flags), size, newest)
    counts = pages.groupBy("slug").agg(F.max("page").alias("pages"))
    state = last.select("slug", "outcome", "status_since", "tool_count", "last_checked", "last_ok")
    known = status(servers.select("slug", "name", "url", "registry_name", "added"), state, "slug")
    rows = known.join(sums, "slug", "left").join(open_, "slug", "left").join(counts, "slug", "left").join(pages, "slug", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
    failing = ~F.col("status").isin("ok", "pending_first_check")
    return rows.select(
        "slug", one("page"), one("pages"), "name", "url", "registry_name", "added", "status", F.when(failing, F.col("status_since")).alias("status_since"), "tool_count", "last_checked", "last_ok",
        "first_seen", "last_change", empty("open_flags"), F.concat(F.lit(f"{base.rstrip('/')}/"), "slug", F.lit("/")).alias("page_url"), empty("entries"),
    )


def event_texts(events: DataFrame, texts: DataFrame) -> DataFrame:
    """events (slug, from_hash, to_hash, type, tool) with ``old_text`` and ``new_text``: the titles and descriptions that they speak of.

    texts (slug, hash, tool, title, description, annotations as JSON) are those of the stored snapshots, found by their content's hash. An
    annotation's event speaks of the title among the annotations. What isn't stored is empty; other events have null.
    """
    stored = texts.groupBy("slug", "hash", "tool").agg(*[F.min(c).alias(c) for c in ("title", "description", "annotations")])  # one hash, one text
    kinds = {"description_changed": F.col("description"), "title_changed": F.col("title"), "annotation_changed": F.get_json_object("annotations", "$.title")}
    said = stored.select("slug", "hash", "tool", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), v.alias("text")) for k, v in kinds.items()])).alias("x")).select("slug", "hash", "tool", "x.*")
    out = events
    for side, of in (("old", "from_hash"), ("new", "to_hash")):
        out = out.join(said.select("slug", F.col("hash").alias(of), "tool", "type", F.col("text").alias(f"{side}_text")), ["slug", of, "tool", "type"], "left")
    shown = F.col("type").isin(*kinds)
    return out.withColumns({f"{side}_text": F.when(shown, F.coalesce(f"{side}_text", F.lit(""))) for side in ("old", "new")})


def _counts_text(counts: Column) -> Column:
    """Counts in words, the worst first: ``1 breaking, 2 info``; ``no classified events`` for none."""
    parts = F.array_compact(F.array(*[F.when(counts[s] > 0, F.concat(counts[s].cast("string"), F.lit(f" {s}"))) for s in SEVERITIES]))
    return F.when(F.size(parts) == 0, "no classified events").otherwise(F.array_join(parts, ", "))


def feed_rows(servers: DataFrame, entries: DataFrame) -> DataFrame:
    """(place, slug, date, key, title): entries as rows of a feed, newest day first, then by server and in the order of their stamps.

    entries are those of ``nested_entries`` with ``to_hash``; a title counts the distinct flags. ``key`` tells entries of a server and day apart.
    """
    rows = entries.join(servers.select("slug", "name"), "slug")
    pair = F.array_join(F.transform(F.coalesce("hashes", F.array().cast("array<string>")), lambda h: F.substring(h, 1, 12)), "-")
    first, change = F.col("kind") == "first_seen", F.col("kind") == "change"
    title = F.when(change, _counts_text(F.col("counts"))).when(first, F.concat(F.lit("first check, "), F.coalesce("tool_count", F.lit(0)).cast("string"), F.lit(" tools"))).otherwise("alternating between two tool lists")
    n = F.size(F.array_distinct(F.transform(F.coalesce(F.col("flags"), F.array().cast(entries.schema["flags"].dataType)), lambda f: f["flag"])))
    noted = F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.when(n == 1, " flag)").otherwise(" flags)"))).otherwise("")
    key = F.when(change, F.substring("to_hash", 1, 12)).when(first, "first").otherwise(F.concat(F.lit("unstable-"), pair))
    out = rows.select("slug", "at", "date", "kind", key.alias("key"), F.concat("name", F.lit(": "), title, noted).alias("title"))
    return placed(out, [F.col("date").desc(), F.col("slug"), F.col("at"), F.col("kind")]).select("place", "slug", "date", "key", "title")

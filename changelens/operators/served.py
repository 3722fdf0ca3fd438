"""Histories and feeds as others serve them: what is known stays, in a safe form, all else drops out.

Texts are read as VARIANT and stay there until a rule has let a value through; nothing is cast
that has another type, so that a number is never taken for a name. A text that is no JSON object, says a key twice or is
beyond a VARIANT's size has no rows here; ``unread`` names it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_text, safe_path, safe_tool
from ..schemas import SEVERITIES

#: What a served history may say.
STATUSES = ("pending_first_check", "ok", "needs_login", "not_reachable", "empty_tools", "failing")
FLAGS = ("description_changed", "annotation_widened", "hidden_characters", "instruction_like_text", "unusual_tool_name")
TEXT_EVENTS = ("description_changed", "title_changed")
DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
STAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"
SLUG = r"\A[a-z0-9][a-z0-9-]{0,62}\z"
HEX = r"\A[0-9a-f]{64}\z"
EVENT_TYPE = r"\A[a-z_]{1,40}\z"
FLAG_DETAIL = r"\A(?:(?:readOnlyHint|destructiveHint|idempotentHint|openWorldHint) (?:true|false) to (?:true|false)|U\+[0-9A-F]{4,6}(?: U\+[0-9A-F]{4,6}){0,40})\z"


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def member(value: Column, key: str) -> Column:
    """A member of a JSON object; null for what is no object or lacks it."""
    return F.try_variant_get(value, f"$['{key}']", "variant")


def text(value: Column, key: str) -> Column:
    """A member that is a string; null for any other."""
    return F.when(_type(member(value, key)) == "STRING", F.try_variant_get(value, f"$['{key}']", "string"))


def whole(value: Column, key: str) -> Column:
    """A member that is a whole number of at least 0, however it is written; null for any other, and for what no long holds."""
    found = member(value, key)
    number = F.when(_type(found).rlike(r"\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(found, "$", "double"))
    return F.when((number >= 0) & (number == F.floor(number)), F.try_variant_get(found, "$", "long"))


def items(value: Column, key: str) -> Column:
    """The items of a member that is a list; none for any other."""
    return F.coalesce(F.try_variant_get(value, f"$['{key}']", "array<variant>"), F.array().cast("array<variant>"))


def strings(value: Column, key: str) -> Column:
    """The strings of a list that aren't empty."""
    found = F.transform(items(value, key), lambda x: F.when(_type(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.filter(found, lambda x: F.coalesce(x != "", F.lit(False)))


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _fitting(value: Column, pattern: str) -> Column:
    return F.when(_sure(value.rlike(pattern)), value).otherwise("")


#: What an event says as text; each is read once, and the rules look at what was read.
EVENT_TEXTS = ("type", "severity", "tool", "path")


def _known_event(said: Callable[[str], Column]) -> Column:
    return _sure(said("type").rlike(EVENT_TYPE) & said("severity").isin(*SEVERITIES))


def _event(said: Callable[[str], Column], value: Column) -> list[Column]:
    """The columns of an event: names and paths in safe form, texts as lengths and hashes."""
    about = said("type").isin(*TEXT_EVENTS)
    lengths = [F.when(about, whole(value, c)).alias(c) for c in ("old_len", "new_len")]
    hashes = [F.when(about, _fitting(text(value, c), HEX)).alias(c) for c in ("old_sha256", "new_sha256")]
    return [said("type").alias("type"), safe_tool(said("tool")).alias("tool"), safe_path(said("path"), said("tool")).alias("path"), said("severity").alias("severity"), *lengths, *hashes]


def events(value: Column, key: str = "events") -> Column:
    """Events of a known form: names and paths in safe form, texts as lengths and hashes."""
    read = F.transform(items(value, key), lambda e: F.struct(*[text(e, c).alias(c) for c in EVENT_TEXTS], e.alias("value")))
    known = F.filter(read, lambda x: _known_event(lambda c: x[c]))
    return F.transform(known, lambda x: F.struct(*_event(lambda c: x[c], x["value"])))


def flags(value: Column, key: str = "flags") -> Column:
    """Flags of a known name; a detail that isn't one of the known forms is left empty."""
    read = F.transform(items(value, key), lambda f: F.struct(*[text(f, c).alias(c) for c in ("flag", "tool", "detail")]))
    known = F.filter(read, lambda f: _sure(f["flag"].isin(*FLAGS)))
    return F.transform(known, lambda f: F.struct(f["flag"].alias("flag"), safe_tool(f["tool"]).alias("tool"), _fitting(f["detail"], FLAG_DETAIL).alias("detail")))


def _known_entry(date: Column, kind: Column) -> Column:
    return _sure(date.rlike(DAY) & kind.isin("first_seen", "change", "unstable"))


def entries(value: Column, key: str = "entries") -> Column:
    """A history's entries: changes with events and flags, first sights with a count and flags, unstable pairs with hashes."""

    def one(x: Column) -> Column:
        kind, e = x["kind"], x["value"]
        return F.struct(
            x["date"].alias("date"),
            kind.alias("kind"),
            F.when(kind == "first_seen", whole(e, "tool_count")).alias("tool_count"),
            F.when(kind == "change", events(e)).alias("events"),
            F.when(kind != "unstable", flags(e)).alias("flags"),
            F.when(kind == "unstable", F.filter(strings(e, "hashes"), lambda h: h.rlike(HEX))).alias("hashes"),
        )

    read = F.transform(items(value, key), lambda e: F.struct(text(e, "date").alias("date"), text(e, "kind").alias("kind"), e.alias("value")))
    return F.transform(F.filter(read, lambda x: _known_entry(x["date"], x["kind"])), one)


def _read(served: DataFrame, key: Sequence[str], body: str) -> DataFrame:
    return served.select(*key, F.try_parse_json(F.col(body)).alias("_v"))


def _slashed(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def unread(served: DataFrame, key: Sequence[str], body: str = "body") -> DataFrame:
    """Keys of texts that hold no JSON object; a null text is one."""
    return _read(served, key, body).where(~_sure(_type(F.col("_v")).startswith("OBJECT"))).select(*key)


def newest_read(served: DataFrame, key: Sequence[str], at: str, body: str = "body") -> DataFrame:
    """(key, at, body): each key's last copy that can be read: a broken one leaves the one before in service. Of copies of the same time, the greatest text."""
    good = served.where(_sure(_type(F.try_parse_json(F.col(body))).startswith("OBJECT")))
    return good.groupBy(*key).agg(F.max(F.struct(F.col(at), F.col(body))).alias("_x")).select(*key, "_x.*")


def _each(rows: DataFrame, value: str, key: str, place: str, item: str) -> DataFrame:
    """rows without ``value``, a row for each item of its member that is a list; none for any other.

    An object and a list are taken apart by ``variant_explode``, as casting a list to an array builds each of its items anew.
    """
    keep, apart = [c for c in rows.columns if c != value], lambda c: rows.sparkSession.tvf.variant_explode(F.col(c).outer()).toDF("_at", "_key", "_value")
    members = rows.lateralJoin(apart(value)).where(F.col("_key") == key).select(*keep, F.col("_value").alias(item))
    return members.lateralJoin(apart(item)).where("_key is null").select(*keep, F.col("_at").alias(place), F.col("_value").alias(item))


def _servers(served: DataFrame, key: Sequence[str], body: str, index: Column) -> DataFrame:
    """(key, _index, place, slug, _url, _s): a row for each server whose slug and https address are in order."""
    s = F.col("_s")
    rows = _each(_read(served, key, body).select(*key, index.alias("_index"), "_v"), "_v", "servers", "place", "_s")
    rows = rows.select(*key, "_index", "place", text(s, "slug").alias("slug"), text(s, "url").alias("_url"), "_s")
    return rows.where(_sure(F.col("slug").rlike(SLUG) & F.col("_url").rlike(r"\Ahttps://\S+\z")))


def histories(served: DataFrame, key: Sequence[str], body: str = "body", origin: str = "", index: str = "mcp-servers") -> DataFrame:
    """(key, place, slug, name, url, registry_name, status, status_since, tool_count, last_checked, first_seen, last_change, open_flags, page_url, entries, entry_count).

    One row for each server of each text whose slug and https address are in order, ``place`` being its place in the list (from 0).
    Stamps and days of another form are empty, an unknown status is ``failing``; a slug said twice is two rows.
    ``entry_count`` is the number of ``entries``; asked for alone, it is told without making them.
    """
    given = text(F.col("_v"), "index_url")
    at = F.when(_sure(given.rlike(r"\Ahttps?://")), given).otherwise(F.lit(f"{origin}/{index}/"))
    rows = _servers(served, key, body, _slashed(at))
    s, slug = F.col("_s"), F.col("slug")
    status, name = text(s, "status"), plain_text(text(s, "name"), 100)
    return rows.select(
        *key,
        "place",
        "slug",
        F.when(name == "", slug).otherwise(name).alias("name"),
        plain_text(F.col("_url"), 300).alias("url"),
        plain_text(text(s, "registry_name"), 200).alias("registry_name"),
        F.when(_sure(status.isin(*STATUSES)), status).otherwise("failing").alias("status"),
        *[_fitting(text(s, c), STAMP).alias(c) for c in ("status_since", "last_checked")],
        whole(s, "tool_count").alias("tool_count"),
        *[_fitting(text(s, c), DAY).alias(c) for c in ("first_seen", "last_change")],
        F.filter(strings(s, "open_flags"), lambda f: f.isin(*FLAGS)).alias("open_flags"),
        F.concat("_index", slug, F.lit("/")).alias("page_url"),
        entries(s).alias("entries"),
        F.size(F.filter(items(s, "entries"), lambda e: _known_entry(text(e, "date"), text(e, "kind")))).alias("entry_count"),
    )


def history_events(served: DataFrame, key: Sequence[str], body: str = "body") -> DataFrame:
    """(key, place, slug, entry, date, event, type, tool, path, severity, old_len, new_len, old_sha256, new_sha256).

    One row for each event that ``histories`` has in its entries, ``entry`` and ``event`` being the places in the lists as they were
    served (from 0). Lists are taken apart row by row, so that no list of a server's events is made.
    """
    e, x, place = F.col("_e"), F.col("_x"), [*key, "place", "slug"]
    rows = _each(_servers(served, key, body, F.lit("")).select(*place, "_s"), "_s", "entries", "entry", "_e")
    rows = rows.select(*place, "entry", text(e, "date").alias("date"), text(e, "kind").alias("_kind"), "_e").where(_known_entry(F.col("date"), F.col("_kind")) & (F.col("_kind") == "change"))
    place += ["entry", "date"]
    rows = _each(rows.select(*place, "_e"), "_e", "events", "event", "_x").select(*place, "event", *[text(x, c).alias(f"_{c}") for c in EVENT_TEXTS], "_x")
    said = lambda c: F.col(f"_{c}")
    return rows.where(_known_event(said)).select(*place, "event", *_event(said, x))


RECORD_TEXTS = ("vendor", "summary", "detail", "fix_hint", "kind", "surface", "scope", "verified_on", "review", "source_url")
RECORD_LISTS = ("signatures", "exclude", "files", "named")


def _alternatives(value: Column, key: str) -> Column:
    """Lists of words that must occur together; a bare word is a list of its own."""
    words = lambda x: F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda w: F.when(_type(w) == "STRING", F.try_variant_get(w, "$", "string"))), lambda w: w.isNotNull())
    return F.array_compact(F.transform(items(value, key), lambda x: F.when(_type(x) == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(words(x))))


def feed_records(served: DataFrame, key: Sequence[str], extension: str, body: str = "body", origin: str = "") -> DataFrame:
    """(key, place, id, effective, severity, texts, lists, context, repo_context, record_url): the records of served JSON feeds.

    A record is what an item holds under ``extension``; without an id, a day and a known severity it isn't one. Missing texts are empty.
    """
    v = F.col("_v")
    home = text(v, "home_page_url")
    at = F.when(_sure(home != ""), _slashed(home)).otherwise(F.lit(f"{origin}/"))
    rows = _read(served, key, body).select(*key, at.alias("_home"), F.posexplode(items(v, "items")).alias("place", "_i"))
    rows = rows.withColumn("_r", member(F.col("_i"), extension))
    r, url = F.col("_r"), text(F.col("_i"), "url")
    rows = rows.where(_sure(text(r, "id").isNotNull() & text(r, "effective").rlike(DAY) & text(r, "severity").isin(*SEVERITIES)))
    return rows.select(
        *key,
        "place",
        *[text(r, c).alias(c) for c in ("id", "effective", "severity")],
        *[F.coalesce(text(r, c), F.lit("")).alias(c) for c in RECORD_TEXTS],
        *[strings(r, c).alias(c) for c in RECORD_LISTS],
        *[_alternatives(r, c).alias(c) for c in ("context", "repo_context")],
        F.when(_sure(url != ""), url).otherwise(F.concat("_home", F.lit("records/"), text(r, "id"))).alias("record_url"),
    )

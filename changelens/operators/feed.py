"""The feed of change records: which count, in which order, and what is known of each identifier."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_slug
from ..schemas import SEVERITIES, rank
from . import ranks


def _day(today: str) -> Column:
    return F.lit(today).cast("date")


def human_verified(verified: Column, by: Column, machine: str) -> Column:
    """Verified by somebody whose name doesn't begin as the machine's."""
    return verified & ~F.lower(F.trim(by)).startswith(machine.lower())


def published(records: DataFrame, failed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Verified records that aren't illustrations, less those whose evidence was found missing."""
    out = records.where("verified and not illustrative")
    return out if failed is None else out.join(failed.where("status = 'missing'").select(F.col("id").alias(key)), key, "left_anti")


def violations(records: DataFrame) -> DataFrame:
    """Add ``violations``: the rules that a record breaks (an empty array for a good one)."""
    words = F.flatten(F.coalesce("context", F.array()))
    rules = {
        "kind": ~F.coalesce(F.col("kind").isin("rest", "mcp", "sdk", "model"), F.lit(False)),
        "severity": ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)),
        "effective": F.col("effective").isNull(),
        "unbacked": F.col("verified") & ((F.coalesce("source_url", F.lit("")) == "") | (F.coalesce("verified_by", F.lit("")) == "") | F.col("verified_on").isNull() | (F.size(F.coalesce("evidence", F.array())) == 0)),
        "context": F.exists(words, lambda w: w.startswith("dep:")) | F.exists(F.coalesce("context", F.array()), lambda g: F.size(g) == 0),
        "files": F.exists(F.coalesce("files", F.array()), lambda g: F.trim(g) == ""),
        "evidence": F.exists(F.coalesce("evidence", F.array()), lambda e: F.char_length(F.trim(F.regexp_replace(e.text, "[`*]", ""))) < 4),
    }
    return records.withColumn("violations", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def feed_order(*, newest_first: bool = True, severity: str = "severity", effective: str = "effective", tie: Sequence[str] = ("load_ordinal",)) -> list[Column]:
    """The site's order: latest first, the worst of a day first, else as loaded."""
    day = F.desc(effective) if newest_first else F.asc(effective)
    return [day, rank(F.col(severity)).asc(), *map(F.asc, tie)]


def export_order(tie: Sequence[str] = ("load_ordinal",)) -> list[Column]:
    """The export's order: date and rank both descending."""
    return [F.desc("effective"), rank(F.col("severity")).desc(), *map(F.asc, tie)]


def upcoming(records: DataFrame, today: str, days: int = 180, limit: int | None = None, effective: str = "effective", order: Sequence[Column] | None = None) -> DataFrame:
    """Records that take effect from today to ``days`` later, both included."""
    out = records.where(F.col(effective).between(_day(today), F.date_add(_day(today), days)))
    out = out.orderBy(*(order or [F.asc(effective), rank(F.col("severity")).asc(), F.asc("id")]))
    return out if limit is None else out.limit(limit)


def retired(records: DataFrame, today: str) -> DataFrame:
    """Models that are gone."""
    return records.where((F.col("kind") == "model") & (F.col("severity") == "breaking") & (F.col("effective") <= _day(today))).orderBy(F.desc("effective"), "id")


def phase(effective: Column, today: str) -> Column:
    """``coming up`` after today, ``in effect`` from today on."""
    return F.when(effective > _day(today), "coming up").otherwise("in effect")


def next_dates(records: DataFrame, today: str, n: int = 5) -> DataFrame:
    """The next changes by date, severity and id."""
    return records.where(F.col("effective") >= _day(today)).orderBy("effective", rank(F.col("severity")), "id").limit(n)


def lead(records: DataFrame, by: Sequence[str], today: str, effective: str = "effective", id_: str = "id") -> DataFrame:
    """One record for each key: the earliest that is still to come, else the latest past one.

    Of equal dates the first by id leads if to come, the last if past.
    """
    ahead = F.col(effective) > _day(today)
    order = Window.partitionBy(*by).orderBy(ahead.desc(), F.when(ahead, F.col(effective)).asc(), F.when(ahead, F.col(id_)).asc(), F.desc(effective), F.desc(id_))
    return records.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def next_by_vendor(records: DataFrame, today: str) -> DataFrame:
    """Each vendor's next change."""
    return records.where(F.col("effective") > _day(today)).groupBy("vendor").agg(F.min_by(F.struct("id", "effective", "severity"), F.struct("effective", "id")).alias("next")).select("vendor", "next.*")


def severity_counts(events: DataFrame, severity: str = "severity") -> DataFrame:
    """Counts by severity, the worst first; severities without events have no row."""
    return events.groupBy(severity).agg(F.count("*").alias("n")).orderBy(rank(F.col(severity)))


def vendor_counts(records: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Counts by vendor, most first, then by name without regard to case."""
    counts = records.groupBy(vendor).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.lower(vendor), vendor)))


def kind_counts(records: DataFrame) -> DataFrame:
    """Counts by what a record is about; a breaking change of a model is a retirement."""
    what = F.when((F.col("kind") == "model") & (F.col("severity") == "breaking"), "retirement").otherwise(F.col("kind"))
    counts = records.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    return counts.withColumn("label", F.concat_ws(" ", F.col("n").cast("string"), F.concat("what", F.when(F.col("n") == 1, "").otherwise("s"))))


def by_month(records: DataFrame, effective: str = "effective") -> DataFrame:
    return records.groupBy(F.date_trunc("month", effective).cast("date").alias("month")).agg(F.count("*").alias("n")).withColumn("name", F.date_format("month", "MMMM yyyy"))


def identifiers(records: DataFrame, slug: Column) -> DataFrame:
    """A row for each identifier: its spellings and the records that name it, both sorted."""
    rows = records.select("id", "effective", F.explode("signatures").alias("signature")).withColumn("slug", slug)
    spelling = F.transform(F.array_sort(F.collect_set(F.struct(F.lower("signature").alias("a"), (F.lower("signature") != F.col("signature")).alias("b"), F.col("signature").alias("c")))), lambda x: x.c)
    return rows.groupBy("slug").agg(spelling.alias("spellings"), F.transform(F.array_sort(F.collect_set(F.struct("effective", "id"))), lambda x: x.id).alias("records"))


#: What an identifier with a page of its own looks like, and its least length.
IDENTIFIER = r"\A/?[A-Za-z0-9][A-Za-z0-9._/-]*[A-Za-z0-9]\z"
IDENTIFIER_LENGTH = 4


def page_identifiers(records: DataFrame) -> DataFrame:
    """(record's columns, signature): identifiers of models that get a page, from records without a scope; code fragments get none."""
    bare = F.lit(True)
    for c in ("context", "files", "repo_context"):
        bare = bare & (F.size(F.coalesce(F.col(c), F.array())) == 0)
    rows = records.where((F.col("kind") == "model") & bare).withColumn("signature", F.explode(F.array_distinct("signatures")))
    return rows.where((F.char_length("signature") >= IDENTIFIER_LENGTH) & F.col("signature").rlike(IDENTIFIER) & F.col("signature").rlike("[A-Za-z]"))


def identifiers_by_vendor(records: DataFrame, today: str) -> DataFrame:
    """(vendor, slug, spelling, id, effective, severity): each identifier's page under the vendor of the record that leads it."""
    rows = page_identifiers(records).withColumn("slug", id_slug(F.col("signature")))
    shown = rows.groupBy("slug").agg(F.min_by("signature", F.struct(F.lower("signature"), F.lower("signature") != F.col("signature"), F.col("signature"))).alias("spelling"))
    led = lead(rows.dropDuplicates(["slug", "id"]), ["slug"], today).select("slug", "vendor", "id", "effective", "severity")
    return led.join(shown, "slug").select("vendor", "slug", "spelling", "id", "effective", "severity").orderBy(F.lower("vendor"), "vendor", F.lower("spelling"), "spelling")


def lookup_order(found: DataFrame) -> DataFrame:
    """What a lookup answers: by date, then id."""
    return found.orderBy("effective", "id")


def lead_order(entries: DataFrame) -> DataFrame:
    """Leads of a changelog: by source and date, the last first."""
    return entries.orderBy(F.desc("source"), F.desc("date_text"))


#: Alternatives of a scope that are named before the rest is counted.
SCOPE_SHOWN = 4


def scope_text(context: Column, files: Column, repo_context: Column) -> Column:
    """In which files and repositories a record counts, as a sentence; empty if everywhere.

    Contexts are alternatives of words that must all occur; ``dep:ecosystem:name@16.`` is a dependency.
    """
    groups = lambda c: F.coalesce(c, F.array().cast("array<array<string>>"))
    quoted = lambda w: F.when(w.contains('"'), F.concat(F.lit("'"), w, F.lit("'"))).otherwise(F.concat(F.lit('"'), w, F.lit('"')))
    more = lambda c: F.when(F.size(c) > SCOPE_SHOWN, F.concat(F.lit(" or "), (F.size(c) - SCOPE_SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    words = lambda c: F.concat(F.array_join(F.slice(F.transform(c, lambda g: F.array_join(F.transform(g, quoted), " and ")), 1, SCOPE_SHOWN), " or "), more(c))
    pinned = lambda g: (F.size(g) == 1) & g[0].startswith("dep:")
    pin = r"\Adep:(?:(\w+):)?(.+)@(.+)"
    part = lambda g, n: F.regexp_extract(g[0], pin, n)
    owner = lambda g: F.when(part(g, 1) == "", "").otherwise(F.concat(F.lit(" ("), part(g, 1), F.lit(")")))
    depends = F.transform(F.filter(groups(repo_context), lambda g: pinned(g) & g[0].rlike(pin)), lambda g: F.concat(quoted(F.concat(part(g, 2), F.lit(" "), F.rtrim(part(g, 3), F.lit(".")), F.lit(".x"))), owner(g)))
    rest = F.filter(groups(repo_context), lambda g: ~pinned(g))
    globs = F.coalesce(files, F.array().cast("array<string>"))
    parts = F.array_compact(F.array(
        F.when(F.size(globs) > 0, F.concat(F.lit("files matching "), F.array_join(F.transform(globs, quoted), ", "))),
        F.when(F.size(groups(context)) > 0, F.concat(F.lit("files that mention "), words(groups(context)))),
        F.when(F.size(depends) > 0, F.concat(F.lit("repos that depend on "), F.array_join(depends, " or "))),
        F.when(F.size(rest) > 0, F.concat(F.when(F.size(depends) > 0, "or ").otherwise(""), F.lit("repos that mention "), words(rest), F.lit(" (including dependency manifests)"))),
    ))
    return F.when(F.size(parts) > 0, F.concat(F.lit("Applies only in "), F.array_join(parts, "; "), F.lit("."))).otherwise("")


def search(records: DataFrame, text: str, vendor: str | None = None, limit: int = 20) -> DataFrame:
    """Records that name a text in their summary, vendor or identifiers, without regard to case; in the feed's order."""
    wanted = text.lower()
    found = F.lower("summary").contains(wanted) | F.lower("vendor").contains(wanted) | F.exists("signatures", lambda s: F.lower(s).contains(wanted))
    if vendor is not None:
        found = found & (F.lower("vendor") == vendor.lower())
    return records.where(found).orderBy(*feed_order(tie=["id"])).limit(max(1, min(limit, 50)))


def last_modified(records: DataFrame, by: Sequence[str], today: str) -> DataFrame:
    """When a key's page last changed: a review, or a change that has taken effect since."""
    seen = F.coalesce("verified_on", "effective")
    return records.groupBy(*by).agg(F.max(F.greatest(seen, F.when(F.col("effective") <= _day(today), F.col("effective")))).alias("last_modified"))


def evidence_urls(records: DataFrame) -> DataFrame:
    """(id, url): each address once a record, without fragments."""
    urls = F.array_union(F.array("source_url"), F.transform(F.coalesce("evidence", F.array()), lambda e: e.url))
    bare = F.transform(F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != ""), lambda u: F.split_part(u, F.lit("#"), F.lit(1)))
    return records.select("id", F.explode(F.array_distinct(bare)).alias("url"))


def index_pages(urls: DataFrame, over: int = 2) -> DataFrame:
    """Addresses that more than ``over`` records cite: lists, which say nothing about one of them."""
    return urls.distinct().groupBy("url").agg(F.count("*").alias("cited")).where(F.col("cited") > over)


def relatable_urls(urls: DataFrame, over: int = 2) -> DataFrame:
    return urls.join(index_pages(urls, over).select("url"), "url", "left_anti")


def _item(home: str) -> Column:
    return F.struct(
        F.col("id"), F.concat(F.lit(f"{home}/"), F.col("id"), F.lit(".html")).alias("url"), F.col("summary").alias("title"), F.col("detail").alias("content_text"),
        F.date_format("effective", "yyyy-MM-dd").alias("date"), F.array("vendor", "severity", "kind").alias("tags"),
    )


def feed_items(records: DataFrame, home: str) -> DataFrame:
    """(id, effective, item): each record's item of a JSON Feed, a row each, for feeds of any length."""
    return records.select("id", "effective", F.to_json(_item(home)).alias("item"))


def json_feed(records: DataFrame, title: str, home: str) -> DataFrame:
    """(place, line): the feed as the lines of one JSON document, in the site's order, an item a line."""
    text = lambda x: json.dumps(x, ensure_ascii=False)
    items = ranks.placed(records, feed_order(tie=["id"])).select("place", F.to_json(_item(home)).alias("line"))
    head = ["{" + f'"version":"https://jsonfeed.org/version/1.1","title":{text(title)},"home_page_url":{text(home)},"items":[']
    return ranks.document(head, [items], [], ["]}"])

"""Rows out of documents: retirements from tables, entries from changelogs, signals in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date, since
from ..functions.text import lines
from . import tokens
from .tokens import positions

CODE = r"`([^`]+)`"


def table_rows(pages: DataFrame, keep: Sequence[str], text: str = "markdown") -> DataFrame:
    """(keep, section, header, cells, line_no): the body rows of every pipe table, with the last heading above.

    A table is a run of lines that begin with a pipe; its first is the header.
    """
    rows = lines(pages, text, keep)
    page = Window.partitionBy(*keep).orderBy("line_no")
    heading = F.regexp_extract("line", r"\A#{2,4}\s+(.*?)\s*#*\s*\z", 1)
    rows = rows.withColumn("section", F.last(F.when(heading != "", heading), ignorenulls=True).over(page))
    rows = rows.withColumn("_piped", F.col("line").rlike(r"\A\s*\|"))
    rows = rows.withColumn("_table", F.sum((~F.col("_piped")).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0))).where("_piped")
    cells = F.transform(F.split(F.regexp_replace("line", r"\A\s*\||\|\s*\z", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    rows = rows.withColumn("cells", cells)
    table = Window.partitionBy(*keep, "_table").orderBy("line_no")
    rows = rows.withColumns({"header": F.first("cells").over(table), "_place": F.row_number().over(table)})
    separator = F.forall("cells", lambda c: c.rlike(r"\A:?-+:?\z"))
    return rows.where((F.col("_place") > 1) & ~separator).select(*keep, "section", "header", "cells", "line_no")


def retirements(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """(vendor, model, aliases, shutdown, replacements, section) from pages (source, vendor, markdown).

    Tables count that have a column of models and one of shutdown dates; rows without a date or
    a name are left out. Of rows with the same model and date the one under a dated section stays, and takes
    replacements over from the others if it has none.
    """
    rows = table_rows(pages, ["source", "vendor"], text)
    lower = F.transform("header", F.lower)
    column = lambda want, but="(?!)": F.array_position(F.transform(lower, lambda h: h.rlike(want) & ~h.rlike(but)), F.lit(True)).cast("int")
    # as rows of a generator, what a filter asks for isn't worked out again for it
    places = F.struct(column("model", "replace|substitut|recommend").alias("_m"), column(r"(?=.*(?:shutdown|shut down|retire|deprecat|end))(?=.*date)|shutdown|retirement").alias("_d"), column("replace|substitut|recommend").alias("_r"))
    rows = rows.select("source", "vendor", "section", "cells", "line_no", F.inline(F.array(places)))
    cell = lambda c: F.when(F.col(c) > 0, F.try_element_at("cells", F.col(c)))
    names = lambda c: F.when(F.size(F.regexp_extract_all(c, F.lit(CODE), F.lit(1))) > 0, F.regexp_extract_all(c, F.lit(CODE), F.lit(1))).otherwise(F.filter(F.split(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\s*(?:,|<br\s*/?>|\bor\b)\s*"), lambda x: x.rlike(r"\A[a-zA-Z0-9][\w.:@/-]*\d[\w.:@/-]*\z")))
    rows = rows.where("_m > 0 and _d > 0")
    read = F.struct(names(cell("_m")).alias("ids"), parse_date(cell("_d")).alias("shutdown"), F.coalesce(names(cell("_r")), F.array().cast("array<string>")).alias("replacements"))
    rows = rows.select("vendor", "section", "line_no", "source", F.inline(F.array(read)))
    rows = rows.where(F.col("shutdown").isNotNull() & (F.size("ids") > 0))
    rows = rows.select("*", F.col("ids")[0].alias("model"), F.slice("ids", 2, F.size("ids")).alias("aliases"))
    dated = parse_date(F.coalesce("section", F.lit(""))).isNotNull()
    by = Window.partitionBy("vendor", "model", "shutdown")
    order = by.orderBy(dated.desc(), "source", "line_no")
    filled = F.first(F.when(F.size("replacements") > 0, F.col("replacements")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"replacements": F.coalesce(filled, "replacements"), "_place": F.row_number().over(order)})
    return rows.where("_place = 1").select("vendor", "model", "aliases", "shutdown", "replacements", "section")


def code_id(model: Column) -> Column:
    """How an id is written in code: pages write ``ft-`` where code has ``ft:``."""
    return F.when(model.startswith("ft-"), F.concat(F.lit("ft:"), F.substr(model, F.lit(4)))).otherwise(model)


def uncovered(retired: DataFrame, records: DataFrame, first: str | None = None) -> DataFrame:
    """Retirements (from a day on) in whose ids no identifier of a record of the vendor and date stands as a token."""
    if first is not None:
        retired = retired.where(F.col("shutdown") >= F.lit(first).cast("date"))
    known = records.select("vendor", F.col("effective").alias("shutdown"), F.explode("signatures").alias("_signature")).where("_signature != ''").distinct()
    names = retired.select("vendor", "shutdown", "model", F.explode(F.array_distinct(F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_name")).withColumn("_name", code_id(F.col("_name")))
    pairs = names.join(known, ["vendor", "shutdown"]).where(F.col("_name").contains(F.col("_signature")))
    same = pairs.where(F.col("_name") == F.col("_signature"))
    # the token rule decides where an id only holds the identifier
    longer = pairs.where(F.col("_name") != F.col("_signature"))
    longer = longer.where(F.size(positions(F.col("_name"), F.col("_signature"), F.lit(False), F.array().cast("array<string>"))) > 0)
    hit = same.unionByName(longer).select("vendor", "shutdown", "model").distinct()
    return retired.join(hit, ["vendor", "shutdown", "model"], "left_anti")


def drafts(retired: DataFrame, today: str, horizon: int = 180, shown: int = 4) -> DataFrame:
    """One draft for each vendor, date and section: its ids, and a title with the first few of them."""
    group = retired.groupBy("vendor", "shutdown", "section").agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    more = F.size("models") - shown
    title = F.concat(F.array_join(F.slice("models", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    near = F.datediff("shutdown", F.lit(today).cast("date")) <= horizon
    return group.withColumns({"title": title, "severity": F.when(near, "breaking").otherwise("deprecation")})


#: Patterns of words of a changelog entry that matter alone, and of those that matter in pairs.
STRONG = (
    "(?<!non-)breaking", "(?<!not )deprecat[a-z]*", "remov(?:ed|es|al|ing)", "retir[a-z]*", "renam[a-z]*", "sunset[a-z]*", "no longer", "end[- ]of[- ]life", "shut(?:ting)? ?down", "discontinu[a-z]*",
    "will default", "default[a-z]* (?:will )?change[a-z]*", "will be served by",
)
WEAK = ("remove", "migrat[a-z]*", "redirect[a-z]*", "replaced by", "now requires?", "defaults? to", "drop(?:s|ped)?", "instead of", "previously", "now returns?")


def terms(text: Column, words: Sequence[str]) -> Column:
    """What occurs of the patterns as whole words, in lower case, sorted."""
    pattern = r"(?i)\b(" + "|".join(words) + r")\b(?!_)"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)))


def flagged(entries: DataFrame, text: str = "text", strong: Sequence[str] = STRONG, weak: Sequence[str] = WEAK) -> DataFrame:
    """Entries with one strong word or two different weak ones, and these words."""
    found = entries.withColumns({"_strong": terms(F.col(text), strong), "_weak": terms(F.col(text), weak)})
    found = found.where((F.size("_strong") > 0) | (F.size("_weak") > 1))
    return found.withColumn("flags", F.array_sort(F.array_union("_strong", "_weak"))).drop("_strong", "_weak")


def entry_key(source: Column, date_text: Column, title: Column, text: Column) -> Column:
    """What tells entries apart from run to run."""
    squeezed = F.trim(F.lower(F.regexp_replace(F.concat(title, F.lit(" | "), F.substring(text, 1, 200)), r"(?U)\W+", " ")))
    return F.concat_ws("|", source, date_text, F.substring(F.sha1(squeezed), 1, 16))


def releases(pages: DataFrame, body: str = "body") -> DataFrame:
    """Entries of release lists in JSON; drafts and previews are left out."""
    kind = "array<struct<name:string,tag_name:string,body:string,html_url:string,published_at:string,draft:boolean,prerelease:boolean>>"
    rows = pages.select("source", "vendor", F.inline(F.from_json(body, kind)))
    rows = rows.where(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("prerelease", F.lit(False)))
    title = F.coalesce(F.when(F.col("name") != "", F.col("name")), "tag_name")
    return rows.select("source", "vendor", F.coalesce(F.substring("published_at", 1, 10), F.lit("")).alias("date_text"), title.alias("title"), F.col("html_url").alias("url"), F.coalesce("body", F.lit("")).alias("text"))


_HEADING = re.compile(r"\A(#{1,6})\s+(.*?)\s*#*\s*\Z")
_MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
_US = re.compile(r"\b([A-Z][a-z]{2,8})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b")
_DAY_FIRST = re.compile(r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Z][a-z]{2,8})\.?,?\s+(\d{4})\b")
_MONTH = re.compile(r"\A([A-Z][a-z]{2,8})\.?,?\s+(\d{4})\Z")
_ISO = re.compile(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)")
_UPDATE = re.compile(r"<Update\s+label=\"([^\"]+)\"[^>]*>")


def _date_of(text: str, year: str | None) -> str | None:
    """``yyyy-MM-dd`` or ``yyyy-MM`` of a heading, with the year of one above if it has none itself."""
    if m := _ISO.search(text):
        return m[1]
    if re.fullmatch(r"\d{4}-\d{2}", text):
        return text
    if (m := _MONTH.match(text)) and m[1][:3].lower() in _MONTHS:
        return f"{m[2]}-{_MONTHS[m[1][:3].lower()]:02}"
    if (m := _DAY_FIRST.search(text)) and m[2][:3].lower() in _MONTHS:
        return f"{m[3]}-{_MONTHS[m[2][:3].lower()]:02}-{int(m[1]):02}"
    for m in _US.finditer(text):
        if m[1][:3].lower() in _MONTHS and (m[3] or year):
            return f"{m[3] or year}-{_MONTHS[m[1][:3].lower()]:02}-{int(m[2]):02}"
    return None


#: Lines above a heading among whose last three with text its date may stand, and how long such a line is at most.
LOOK_BACK, DATE_LINE = 30, 30
_LINK = re.compile(r"\[([^\[\]]{1,300})\]\((https?://[^)\s]{1,2000})\)")
_OWN_PAGE = re.compile(r"(?i)learn more|read more|changelog")


def _shown(text: str) -> str:
    """Markdown as it is read: links by their text, no marks, single spaces."""
    text = re.sub(r"(?m)^\s*(?:>\s?)+", "", _LINK.sub(r"\1", text))
    return " ".join(re.sub(r"[*`|#]+", " ", re.sub(r"\A\s*[-*]\s+", "", text)).split())


def _link(text: str) -> str:
    """An entry's own page: a link that says so, else the first."""
    links = list(_LINK.finditer(text))
    return next((m[2] for m in links if _OWN_PAGE.search(m[0])), links[0][2] if links else "")


def _section(title: str, date: str, lines: list[str], pure: bool) -> Iterator[dict]:
    """Entries of a section: its rows with links, or the bullets under a date and what stands beside them, or the whole."""
    entry = lambda shown, text, url: {"title": shown[:140], "date_text": date, "text": text, "url": url}
    rows = [x for x in lines if x.lstrip().startswith("|") and _LINK.search(x)]
    if rows:
        for x in rows:
            m = _LINK.search(x)
            yield entry(_shown(m[1]), _shown(x), m[2])
        return
    bullets: list[str] = []
    loose, inside = [], False
    for x in lines:
        if x[:2] in ("- ", "* "):
            bullets.append(x[2:].strip())
            inside = True
        elif inside and (not x.strip() or x[0] in " \t"):
            bullets[-1] = f"{bullets[-1]} {x.strip()}".strip()
        else:
            inside = False
            loose.append(x.strip())
    body = "\n".join(x.strip() for x in lines if x.strip())
    if pure and len(bullets) > 1:
        if prose := _shown(" ".join(loose)):
            yield entry(prose, prose, _link(title + "\n" + body))
        for x in bullets:
            yield entry(_shown(x), x, _link(x))
    elif body:
        yield entry(_shown(body) if pure else title, body, _link(title) or _link(body))


def _entries(text: str) -> Iterator[dict]:
    """Entries of a changelog page: (title, date_text, text, url); a date is a heading's, one above, or a line just before it."""
    above: list[tuple[int, str | None]] = []
    section: tuple[str, str, list[str], bool] | None = None
    before: list[tuple[int, str]] = []  # the last three lines with text
    for n, line in enumerate(text.splitlines()):
        line = _UPDATE.sub(r"## \1", line).replace("</Update>", "")
        if m := _HEADING.match(line):
            if section:
                yield from _section(*section)
            level, title = len(m[1]), m[2]
            while above and above[-1][0] >= level:
                above.pop()
            inherited = next((d for _, d in reversed(above) if d), None)
            found = _date_of(title, inherited[:4] if inherited else None) or (title if re.fullmatch(r"\d{4}", title) else None)
            date = found or inherited
            if not date or len(date) == 4:
                near = (_date_of(x, None) for at, x in reversed(before) if n - at <= LOOK_BACK and len(x) <= DATE_LINE and not x.startswith("#"))
                date = next((d for d in near if d and len(d) == 10), date)
            above.append((level, date))
            pure = bool(found) and len(re.sub(r"[\w,.:-]+", "", title).split()) == 0 and len(title) <= 30
            section = title, date if date and len(date) > 4 else "", [], pure
        elif section is not None:
            section[2].append(line)
        if line.strip():
            before = [*before[-2:], (n, line.strip())]
    if section:
        yield from _section(*section)


def changelog(pages: DataFrame, body: str = "body") -> DataFrame:
    """Entries of changelog pages in Markdown; if any entry of a page is dated, the undated ones are left out."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("title", "date_text", "text", "url")]))

    @F.arrow_udf("array<struct<title:string,date_text:string,text:string,url:string>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                found = list(_entries(text or ""))
                dated = [e for e in found if e["date_text"]]
                out.append(dated or found)
            yield pa.array(out, kind)

    return pages.select("source", "vendor", F.inline(of(F.col(body))))


def leads(entries: DataFrame, first: str, seen: DataFrame | None = None) -> DataFrame:
    """Flagged entries since a day (at their own precision) that were not seen before."""
    out = flagged(entries.where(since(F.col("date_text"), first)))
    out = out.withColumn("key", entry_key(F.col("source"), F.col("date_text"), F.col("title"), F.col("text")))
    return out if seen is None else out.join(seen.select("key"), "key", "left_anti")


def related(entries: DataFrame, records: DataFrame, urls: DataFrame, least: int = 6) -> DataFrame:
    """(key, id): records of an entry's vendor (names may be prefixes) that share its address or whose identifier its title or text names.

    An identifier is named as a token, in an entry that has the record's context, and not if an exclude of the record that
    holds it stands there too. records: (id, vendor, signatures, and context and exclude where there are any).
    """
    array_ = {"context": "array<array<string>>", "exclude": "array<string>"}
    known = records.select("id", F.col("vendor").alias("v"), "signatures", *[(F.col(c) if c in records.columns else F.lit(None).cast(t)).alias(c) for c, t in array_.items()])
    blob = F.concat_ws("\n", *[c for c in ("title", "text") if c in entries.columns])
    rows = entries.select("key", "vendor", F.split_part("url", F.lit("#"), F.lit(1)).alias("own"), blob.alias("line"))
    # only vendors' names meet each with each; entries and records are joined by them
    vendors = rows.select("vendor").distinct().join(known.select("v").distinct(), F.col("vendor").startswith(F.col("v")) | F.col("v").startswith(F.col("vendor")))
    hits = lambda column, size: tokens.token_hits(rows.select("key", "line"), tokens.signature_table(known.select("id", F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda s: F.char_length(s) >= size).alias("signatures"), F.lit("rest").alias("kind"))), ["key"]).select("key", F.col("record_id").alias("id"), "signature").distinct()
    named, excluded = hits("signatures", least), hits("exclude", 1).withColumnRenamed("signature", "_other")
    covered = named.join(excluded, ["key", "id"]).where(F.col("_other").contains(F.col("signature"))).select("key", "id", "signature")
    left = named.join(covered, ["key", "id", "signature"], "left_anti").select("key", "id").distinct()
    in_context = left.join(rows.join(vendors, "vendor"), "key").join(known.select("id", "v", "context"), ["id", "v"]).where(tokens.context_matches(F.col("line"), F.coalesce("context", F.array().cast("array<array<string>>"))))
    cited = rows.join(vendors, "vendor").join(urls.select("id", F.col("url").alias("own")), "own").join(known.select("id", "v"), ["id", "v"])
    return in_context.select("key", "id").union(cited.select("key", "id")).distinct()

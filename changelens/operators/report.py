"""What a scan says: the first sites of each record, counts, and exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_test
from ..schemas import rank
from ..session import checkpoint
from . import feed, ranks


def top_sites(sites: DataFrame, n: int, by: Sequence[str] = ("record_id",), order: Sequence[str] = ("file", "line", "start")) -> DataFrame:
    """The first n sites of each record, and how many there are in all."""
    window = Window.partitionBy(*by).orderBy(*order)
    counts = F.count("*").over(Window.partitionBy(*by))
    return sites.withColumns({"place": F.row_number().over(window), "sites": counts}).where(F.col("place") <= n)


def first_by_line(sites: DataFrame, via: str = "via") -> DataFrame:
    """One site for each file and line; direct hits win over uses of a constant."""
    order = Window.partitionBy("record_id", "file", "line").orderBy((F.col(via) != "").asc(), "start")
    return sites.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def split_counts(sites: DataFrame, path: str = "file", by: Sequence[str] = ("record_id",)) -> DataFrame:
    """Sites by whether they are used in code, listed in a table, or in a test."""
    test = in_test(F.col(path))
    listed = (F.col("tier") == "listed") & ~test
    return sites.groupBy(*by).agg(F.count("*").alias("sites"), F.count_if(~test & ~listed).alias("in_code"), F.count_if(listed).alias("listed"), F.count_if(test).alias("in_test"))


def totals(sites: DataFrame, records: DataFrame) -> DataFrame:
    """Records that hit, and how many of them break or change silently."""
    hit = records.join(sites.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi")
    return hit.agg(F.count("*").alias("records"), F.count_if(F.col("severity") == "breaking").alias("breaking"), F.count_if(F.col("severity") == "silent").alias("silent"))


def order(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Records of a report: the worst first, then those with most uses."""
    return counts.join(records, counts.record_id == records.id).orderBy(rank(F.col("severity")), F.desc("in_code"), F.desc("listed"), "effective", "id")


def fit_sites(sites: DataFrame, budget: int, tries: Sequence[int] = (5, 3, 1, 0)) -> int:
    """The most sites for each record whose lines fit a budget of characters; the last try if none does."""
    placed = top_sites(sites, max(tries)).withColumn("_size", F.char_length("snippet") + F.char_length("file") + 12)
    sizes = placed.agg(*[F.coalesce(F.sum(F.when(F.col("place") <= n, F.col("_size"))), F.lit(0)).alias(f"n{n}") for n in tries]).head()
    return next((n for n in tries if sizes[f"n{n}"] <= budget), tries[-1])


def level(severity: Column, tier: Column) -> Column:
    """A finding's level: errors break, the rest warns, lists and news are notes."""
    return F.when((tier == "listed") | severity.isin("additive", "info"), "note").when(severity == "breaking", "error").otherwise("warning")


#: The longest texts of a rule, and a report's size and what is left for its end.
SHORT_TEXT, FULL_TEXT = 1000, 4000
REPORT_CHARS, REPORT_END = 60_000, 200


def trust(machine: str) -> Column:
    """Who has looked at a record, in words. machine: how the names of reviewers that are no persons begin."""
    by_machine = F.concat(F.lit("reviewed against source "), F.date_format("verified_on", "yyyy-MM-dd"), F.lit(" (AI-assisted)"))
    return F.when(feed.human_verified(F.col("verified"), F.col("verified_by"), machine), F.concat(F.lit("verified by "), "verified_by")).when(F.col("verified"), by_machine).otherwise("unreviewed draft: confirm before acting")


def sarif(sites: DataFrame, records: DataFrame, tool: str, machine: str = "AI") -> DataFrame:
    """(place, line): a SARIF 2.1.0 document of a scan's findings as lines in order, a rule or a finding each, for scans of any length.

    sites: (record_id, file, line, start, signature, snippet, via, tier); records that hit are the rules. Sites are found once.
    """
    sites = checkpoint(sites.select("record_id", "file", "line", "start", "signature", "snippet", "via", "tier"))
    text = lambda c: F.struct(c.alias("text"))
    none = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    hit = records.join(sites.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi")
    severe = level(F.col("severity"), F.lit("use"))
    rule = F.struct(
        "id", F.replace(F.col("id"), F.lit("-"), F.lit("_")).alias("name"), text(F.substring(F.concat("vendor", F.lit(": "), "summary"), 1, SHORT_TEXT)).alias("shortDescription"), text(F.substring(none("detail", F.col("summary")), 1, FULL_TEXT)).alias("fullDescription"),
        text(F.concat(none("fix_hint", F.lit("See source.")), F.lit("\n\nSource: "), none("source_url", F.lit("n/a")), F.lit(" ("), trust(machine), F.lit(")"))).alias("help"), F.when(F.col("source_url").rlike("\\Ahttps?://"), F.col("source_url")).alias("helpUri"),
        F.struct(severe.alias("level")).alias("defaultConfiguration"), F.struct(F.array("vendor", "kind", "severity").alias("tags"), F.date_format("effective", "yyyy-MM-dd").alias("effective")).alias("properties"),
    )
    rules = ranks.placed(hit, [F.col("id").asc()]).select("place", F.to_json(rule).alias("line"))
    rows = sites.join(records.select(F.col("id").alias("record_id"), "vendor", "severity", "summary", F.date_format("effective", "yyyy-MM-dd").alias("effective")), "record_id")
    named = F.concat(F.lit("`"), "signature", F.lit("`"))
    how = F.when(F.coalesce("via", F.lit("")) == "", named).otherwise(F.concat(F.lit("uses "), "via", F.lit(", which holds "), named))
    message = F.concat("vendor", F.lit(" "), "severity", F.lit(" change effective "), "effective", F.lit(": "), "summary", F.lit(" ("), how, F.lit(")"), F.when(F.col("tier") == "use", "").otherwise(" [listed in a table or enum, not a request]"))
    mark = F.sha2(F.concat_ws(":", "record_id", "file", "signature", "snippet"), 256)
    place = F.struct(F.struct(F.struct(F.replace("file", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("record_id").alias("ruleId"), level(F.col("severity"), F.col("tier")).alias("level"), text(message).alias("message"), F.array(place).alias("locations"), F.struct(mark.alias("site")).alias("partialFingerprints"), F.struct(in_test(F.col("file")).alias("inTest"), "tier").alias("properties"))
    results = ranks.placed(rows, [F.col(c).asc() for c in ("record_id", "file", "line", "start")]).select("place", F.to_json(result).alias("line"))
    head = ['{"version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"rules":[']
    return ranks.document(head, [rules, results], [']}},"results":['], ["]}]}"])


def change_lines(counts: DataFrame, records: DataFrame, today: str) -> DataFrame:
    """(order of a report's columns, line): a report's row for each change, the worst first.

    counts: of ``split_counts``. Bars and line ends in texts are escaped.
    """
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = counts.join(records, counts.record_id == records.id)
    when = F.when(F.col("effective") <= F.lit(today).cast("date"), " (in effect)").otherwise(" (coming)")
    source = F.when(F.col("source_url").rlike("\\Ahttps?://"), F.concat(F.lit(" ([source]("), "source_url", F.lit("))"))).otherwise("")
    numbers = [x for c in ("in_code", "listed", "in_test") for x in (F.lit(" | "), F.col(c).cast("string"))]
    line = F.concat(F.lit("| "), "severity", F.lit(" | **"), cell("vendor"), F.lit("**: "), cell("summary"), source, F.lit(" | "), F.date_format("effective", "yyyy-MM-dd"), when, *numbers, F.lit(" |"))
    return rows.select(rank(F.col("severity")).alias("rank"), "in_code", "listed", "effective", "id", line.alias("line"))


def hard_stop(lines: DataFrame, limit: int = REPORT_CHARS) -> DataFrame:
    """(place, line): the lines of ``change_lines`` in a report's order, up to a size in characters.

    A report that fits is whole; a longer one is cut at ``REPORT_END`` characters under the limit.
    """
    order = [F.asc("rank"), F.desc("in_code"), F.desc("listed"), F.asc("effective"), F.asc("id")]
    whole = lines.agg(F.coalesce(F.sum(F.char_length("line") + 1), F.lit(0))).head()[0] <= limit
    return ranks.cut(lines, order, limit if whole else limit - REPORT_END)


def scan_items(sites: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, file, line, signature, item): each site as a line of JSON with its record, for scans of any length."""
    own = records.select(F.col("id").alias("record_id"), F.struct("id", "vendor", "severity", F.date_format("effective", "yyyy-MM-dd").alias("effective"), "summary", "source_url").alias("_record"))
    rows = sites.join(own, "record_id")
    site = F.struct("file", "line", "signature", F.coalesce("via", F.lit("")).alias("via"), in_test(F.col("file")).alias("in_test"))
    return rows.select("record_id", "file", "line", "signature", F.to_json(F.struct(F.col("_record").alias("record"), site.alias("site"))).alias("item"))

"""Dates in prose, and dates known by month only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def parse_date(text: Column) -> Column:
    """The first of: an ISO date, ``Month d, yyyy``, ``d Month yyyy`` (ordinals and Sept allowed); null for none."""
    flat = F.regexp_replace(F.regexp_replace(text, "[‐-―−]", "-"), r"[\s ]+", " ")
    iso = r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"
    us = rf"(?i)\b({MONTHS})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b"
    uk = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)? ({MONTHS})\.?,? (\d{{4}})\b"
    of = lambda d, m, y: F.try_to_date(F.concat_ws(" ", d, F.initcap(F.substring(m, 1, 3)), y), "d MMM yyyy")
    x = F.regexp_extract

    # texts and matches are found once each; a text without a match isn't tried as a date, which would raise an error for each
    def named(t: Column, p: str, *places: int) -> Column:
        return _let(x(t, p, 0), lambda m: F.when(m != "", of(*[x(m, p, i) for i in places])))

    def first(t: Column) -> Column:
        return F.coalesce(_let(x(t, iso, 1), lambda m: F.when(m != "", F.try_to_date(m, "yyyy-MM-dd"))), named(t, us, 2, 1, 3), named(t, uk, 1, 2, 3))

    return _let(flat, first)


def since(date_text: Column, first: str) -> Column:
    """Whether a date of any precision isn't before ``first``: compared at its own precision; undated passes."""
    return date_text >= F.substring(F.lit(first), 1, F.char_length(date_text))


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMMM yyyy")


def days_until(date: Column, today: str) -> Column:
    return F.datediff(date, F.lit(today).cast("date"))

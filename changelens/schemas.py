"""Schemas of the tables, and the order of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the worst to the least, kinds of surfaces.
SEVERITIES = ("breaking", "silent", "deprecation", "additive", "info")
KINDS = ("rest", "mcp", "sdk", "model")

RECORDS = """
    id string, vendor string, surface string, kind string, severity string, effective date, summary string, detail string,
    signatures array<string>, source_url string, verified boolean, verified_by string, verified_on date,
    evidence array<struct<url:string,text:string>>, fix_hint string, illustrative boolean, context array<array<string>>,
    files array<string>, repo_context array<array<string>>, exclude array<string>, load_ordinal int
"""
SITES = "record_id string, file string, line int, signature string, start int, snippet string"
EVENTS = "path string, change string, before string, after string, severity string"


def rank(severity: Column) -> Column:
    """0 for the worst severity; null for an unknown one."""
    out = None
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i) if out is None else out.when(severity == name, i)
    return out

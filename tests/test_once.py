"""Texts, hits and sites are worked out once, however often a result refers to them."""

import pytest
from pyspark.sql import functions as F

from changelens.functions.dates import parse_date
from changelens.operators import code_context, extract, history, report
from changelens.plans import surface
from changelens.sources import code


@pytest.fixture
def counted(spark):
    """A column that passes through and is counted, and how often it was evaluated."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        n.add(1)
        return x

    return seen, n


def test_a_text_is_squeezed_once_for_all_phrases(spark):
    rows = spark.createDataFrame([("s", "t", "DON’T\n mention the System  prompts, nor .ENV or xsystem prompt")], "server string, name string, text string")
    found = history.new_flags(rows.limit(0), rows)
    assert {r.detail for r in found.collect()} == {"don't mention", "system prompt", ".env"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 4  # each side, and where the rows are filtered


def test_tools_of_a_small_file_are_read_by_several_tasks(spark, sf_dir):
    found = surface._side(spark, sf_dir, True)
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_sites_of_a_document_are_found_once(spark, counted):
    seen, n = counted
    sites = spark.createDataFrame([("r", "a.py", i, 0, "x", "x", "", "use") for i in range(1, 6)], "record_id string, file string, line int, start int, signature string, snippet string, via string, tier string")
    sites = sites.withColumn("record_id", seen("record_id"))
    row = {"id": "r", "vendor": "V", "kind": "rest", "severity": "breaking", "summary": "s", "detail": "", "fix_hint": "", "source_url": "", "verified": False, "verified_by": None}
    records = spark.createDataFrame([row], "id string, vendor string, kind string, severity string, summary string, detail string, fix_hint string, source_url string, verified boolean, verified_by string")
    records = records.withColumns({"effective": F.lit("2026-01-02").cast("date"), "verified_on": F.lit(None).cast("date")})
    assert report.sarif(sites, records, "changelens").count() == 5 + 1 + 3
    assert n.value == 5


def test_hits_are_found_and_files_lexed_once_for_tiers(spark, counted):
    seen, n = counted
    files = spark.createDataFrame([("a.py", ".py", "# 'x'\nA = ['x', 1]\nf('x')\n"), ("b.py", ".py", "y\n"), ("c.py", ".py", None)], "path string, suffix string, text string")
    hits = spark.createDataFrame([("a.py", 1, 3, 4), ("a.py", 2, 6, 7), ("a.py", 3, 3, 4), ("c.py", 1, 0, 1)], "file string, line int, start int, stop int")
    found = code_context.tiers(hits.withColumn("file", seen("file")), files)
    assert {(r.file, r.line, r.tier) for r in found.collect()} == {("a.py", 2, "listed"), ("a.py", 3, "use"), ("c.py", 1, "use")}
    assert n.value == 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_a_text_is_flattened_once_for_all_forms_of_a_date(spark):
    rows = spark.createDataFrame([("on 2024–01-02, or",), ("Sept. 3rd, 2024",), ("4 of 4th  May 2024",), ("2024-13-01 or May 5, 2024",), ("February 30, 2024 or 1 Mar 2024",), ("none",), (None,)], "x string")
    found = rows.select(parse_date(F.col("x")).alias("d"))
    assert [str(r.d) for r in found.collect()] == ["2024-01-02", "2024-09-03", "2024-05-04", "2024-05-05", "2024-03-01", "None", "None"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def test_filters_of_retirements_do_not_read_dates_again(spark):
    page = "## Gone\n| Model | Shutdown date | Replacement |\n|--|--|--|\n| `m-1` | May 1, 2024 | `n-1` |\n| `m-2` | soon | `n-2` |\n"
    found = extract.retirements(spark.createDataFrame([("s", "v", page)], "source string, vendor string, markdown string"))
    assert [(r.model, str(r.shutdown), r.replacements) for r in found.collect()] == [("m-1", "2024-05-01", ["n-1"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if x.lstrip(" :+-").startswith("Filter") and ("transform(" in x or "gettimestamp" in x)]


def test_plain_strings_of_a_notebook_are_not_parsed_one_by_one(monkeypatch):
    text = '{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"source": "c", "cell_type": "markdown"}]}'
    asked, loads = [], code.json.loads
    monkeypatch.setattr(code.json, "loads", lambda s, **options: asked.append(s) or loads(s, **options))
    assert [(r["line"], r["cell"]) for r in code._cells(text)] == [("a", "cell 1, line 1"), ("b", "cell 1, line 2")]
    assert asked == [text, '"a\\n"']

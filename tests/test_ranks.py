import json

from pyspark.sql import functions as F

from changelens.operators import feed, ranks, report


def test_places_and_sums(spark):
    rows = [(i, (i * 7919) % 1000, None if i % 10 == 0 else i % 5, "own", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, key int, size int, part string, place long").repartition(9)
    order = [F.col("key").desc(), F.col("id").asc()]
    found = ranks.placed(df, order, size=F.col("size"))
    want, total = {}, 0
    for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += r[2] or 0
        want[r[0]] = (n, total)
    got = found.collect()
    assert {r.id: (r.place, r.upto) for r in got} == want and {r.part for r in got} == {"own"} and found.columns == ["id", "key", "size", "part", "place", "upto"]
    plan = ranks.placed(df, order)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the parts' own counts


def test_equal_rows_have_places_of_their_own_and_none_no_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 500, "k int, v string")
    assert sorted(r.place for r in ranks.placed(df, [F.asc("k")]).collect()) == list(range(1, 501))
    assert ranks.placed(df.limit(0), [F.asc("k")]).count() == 0 and ranks.cut(df.limit(0), [F.asc("k")], 10, "v").count() == 0


def test_cut(spark):
    df = spark.createDataFrame([(i, f"line {i}é") for i in range(100)], "i int, line string")
    for limit in (0, 1, 7, 8, 9, 100, 10_000):
        got = [r.line for r in ranks.cut(df, [F.asc("i")], limit).orderBy("place").collect()]
        whole = "".join(f"line {i}é\n" for i in range(100))[:limit]
        assert "".join(f"{x}\n" for x in got)[:limit] == whole


def _records(spark, n):
    rows = [(f"r{i:03}", "Acme|Co", "rest", ("breaking", "info")[i % 2], f"2026-01-{i % 28 + 1:02}", f"what {i}\n", "https://x") for i in range(n)]
    return spark.createDataFrame(rows, "id string, vendor string, kind string, severity string, effective string, summary string, source_url string").withColumns({"effective": F.col("effective").cast("date"), "detail": F.lit("d")})


def test_feed_document(spark):
    lines = feed.json_feed(_records(spark, 50), 'The "feed"', "https://h").orderBy("place").collect()
    found = json.loads("\n".join(r.line for r in lines))
    dates = [(x["date"], x["tags"][1], x["id"]) for x in found["items"]]
    assert found["title"] == 'The "feed"' and len(dates) == 50 and dates == sorted(sorted(dates, key=lambda d: (d[1], d[2])), key=lambda d: d[0], reverse=True)
    assert json.loads("".join(r.line for r in feed.json_feed(_records(spark, 0), "t", "h").orderBy("place").collect()))["items"] == []


def test_report_has_a_hard_stop(spark):
    known = _records(spark, 60)
    counts = known.select(F.col("id").alias("record_id"), F.lit(2).alias("in_code"), F.lit(1).alias("listed"), F.lit(0).alias("in_test"))
    lines = report.change_lines(counts, known, "2026-01-10")
    whole = [r.line for r in report.hard_stop(lines).orderBy("place").collect()]
    assert len(whole) == 60 and whole[0] == "| breaking | **Acme\\|Co**: what 0  ([source](https://x)) | 2026-01-01 (in effect) | 2 | 1 | 0 |" and "(coming)" in whole[-1]
    text = "".join(f"{x}\n" for x in whole)
    short = [r.line for r in report.hard_stop(lines, 1000).orderBy("place").collect()]
    assert "\n".join(short).startswith(text[:799]) and len("\n".join(short)) <= 800


def test_containment_in_all_its_ways(spark, monkeypatch):
    from changelens.operators import evidence, tokens

    texts = [(1, "a b c d e f g"), (2, "x a b c d e f"), (3, "a b"), (4, None), (5, ""), (6, "la " * 5000), (7, "a b c d e fg")]
    quotes = [(1, "a b c d e f"), (2, "b"), (3, ""), (4, None), (5, "la la la la la la"), (6, "b c d e f"), (7, "no such words in any of them"), (8, "a b"), (9, "c d e f g")]
    want = {(q, t) for q, x in quotes for t, y in texts if x is not None and y is not None and x in y}
    tables = spark.createDataFrame(quotes, "q int, text string"), spark.createDataFrame(texts, "t int, text string")
    for bounds in ((500_000, 20_000, 20_000), (0, 0, 1)):
        for (module, name), n in zip(((evidence, "BROADCAST_RUNS"), (evidence, "BROADCAST_NEAR"), (tokens, "SCAN_BLOCK")), bounds, strict=True):
            monkeypatch.setattr(module, name, n)
        assert {tuple(r) for r in evidence.containment(*tables, "q", "t").collect()} == want

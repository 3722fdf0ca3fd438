"""Many signatures are joined by what has their outline in a line: as whole texts, each side sent once."""

import random

import duckdb
import pytest

from changelens.catalog import ORACLES, QUERIES
from changelens.operators import tokens


def _same_as_sql(spark, folder, con):
    got = sorted(tuple(r) for r in QUERIES["many_signatures"](spark, str(folder)).collect())
    assert got == sorted(con.execute(ORACLES["many_signatures"]).fetchall())
    return got


def test_neither_lines_nor_signatures_are_sent_more_than_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tokens, "SCAN_ROWS", 0)
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 0)
    plan = QUERIES["many_signatures"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    nodes = [x.lstrip(" :+-").split("[")[0].split(" ")[0].split("(")[0] for x in plan.splitlines()]
    assert nodes.count("Join") == 1 and nodes.count("Aggregate") == 1  # the names once each, and their lines
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    assert len(_same_as_sql(spark, sf_dir, con)) > 1000


@pytest.mark.parametrize("scanned", [0, 20_000])
def test_repeated_odd_and_missing_keys(spark, tmp_path, monkeypatch, scanned):
    monkeypatch.setattr(tokens, "SCAN_ROWS", scanned)
    items = [(1, 1), (1, 1), (1, 2), (1, 3), (-1, 2), (2, -1), (12, 1), (None, 1), (3, None)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (1,), (-1,), (2,), (12,), (None,), (3,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert len(_same_as_sql(spark, tmp_path, con)) == 6


def test_only_tokens_of_an_outline_are_cut_from_a_line():
    cut = lambda text, *outlines: [(text[a:b], model) for a, b, model in tokens.line_spans(text, tokens.outline_tree(outlines))]
    assert cut("see L1-1 and L1-2, not L1-3x", "w-0") == [("L1-1", True), ("L1-2", True)]
    inner = [("mcp__a", False), ("b__c__d", False), ("c__d", False), ("d", False)]
    assert cut("mcp__a-b__c__d-1.5 /v1/x-2", "w-0", "/w/w", "w") == [*inner, ("v1", True), ("/v1/x", False), ("x", False), ("x-2", True)]
    assert cut("a.b(c) _a a_ 1.5", "w.w(", "0") == [("a.b(", True), ("5", True)]
    assert not cut("", "w") and not cut("-_-", "w")


@pytest.mark.parametrize("outlines", [0, 3, 1_000])
def test_outlines_find_what_a_scan_of_all_lines_finds(spark, monkeypatch, outlines):
    monkeypatch.setattr(tokens, "SCAN_ROWS", 0)
    monkeypatch.setattr(tokens, "OUTLINES", outlines)
    dice = random.Random(7)
    pieces = ["a", "b", "1", "2", "_", "__", "-", ".", "\\", "/", "(", " ", "é", "mcp__", "-latest", "-2024", "٣"]
    text = lambda n: "".join(dice.choice(pieces) for _ in range(dice.randint(1, n)))
    records = [(f"r{i}", [text(4), text(3)], dice.choice(["model", "rest", None])) for i in range(250)]
    lines = [(i, text(25)) for i in range(300)] + [(300, None), (301, "")]
    table = tokens.signature_table(spark.createDataFrame(records, "id string, signatures array<string>, kind string"))
    found = tokens.token_hits(spark.createDataFrame(lines, "n int, line string"), table, ["n"])
    got = sorted((r.n, r.record_id, r.signature, r.start, r.stop) for r in found.collect())
    want = []
    for record, signatures, kind in records:
        for s in signatures:
            for written in {s, s.replace(".", "\\.")}:
                end = tokens.re.compile(tokens.token_end(written, kind == "model"))
                want += [(n, record, s, at, at + len(written)) for n, x in lines if x for at in tokens.token_positions(x, written, end, len(written))]
    assert got == sorted(want) and len(got) > 5_000

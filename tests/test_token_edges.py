"""Signatures that stand inside words, or have none, are found on both ways."""

import re

import pytest

from changelens.operators import tokens

SIGNATURES = ["_foo", "foo_", "__", "->", "é", "a__b", "send", "/x_"]
LINES = ["bar_foo", "foo_bar", "_foo", "x__y", "p->q", "café", "mcp__x-y__a__b", "mcp__x__y__a__b", "mcp__x___send", "send", "/x_y", "none", "", None]


@pytest.mark.parametrize("rows_scanned", [0, 20_000])
@pytest.mark.parametrize("block", [3, 20_000])
def test_edges(spark, monkeypatch, rows_scanned, block):
    monkeypatch.setattr(tokens, "SCAN_ROWS", rows_scanned)
    monkeypatch.setattr(tokens, "SCAN_BLOCK", block, raising=False)
    rows = spark.createDataFrame(list(enumerate(LINES)), "n int, line string")
    records = spark.createDataFrame([("a", SIGNATURES, "rest"), ("b", ["_foo"], "model")], "id string, signatures array<string>, kind string")
    got = sorted((r.n, r.record_id, r.signature, r.start, r.stop) for r in tokens.token_hits(rows, tokens.signature_table(records), ["n"]).collect())
    want = []
    for record, s, model in [*(("a", s, False) for s in SIGNATURES), ("b", "_foo", True)]:
        p = re.compile(tokens.python_pattern(s, model, ()))
        want += [(i, record, s, at, at + len(s)) for i, x in enumerate(LINES) if x for at in tokens.token_positions(x, s, p)]
    assert got == sorted(want) and {s for _, _, s, *_ in got} == set(SIGNATURES)

"""Served histories and feeds: only what is known comes through."""

import hashlib
import json

from changelens.operators import served

H = "a" * 64


def sha(s):
    return "sha256:" + hashlib.sha256(s.encode()).hexdigest()


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "k int, body string")


def one(spark, entries):
    server = {"slug": "a", "url": "https://a", "entries": entries}
    return served.histories(docs(spark, {"servers": [server]}), ["k"]).collect()[0].asDict(True)


def test_servers_of_another_form_drop_out(spark):
    good = {"slug": "a", "url": "https://a/b", "name": "N​ame\u0007", "status": "on fire", "status_since": "yesterday", "tool_count": 3.0, "first_seen": "2024-01-01", "last_change": "soon"}
    bad = [{**good, "slug": s} for s in ("A", "-a", "", "a" * 64, 7, None, "a\n")] + [{**good, "url": u} for u in ("http://a", "https://", "https://a b", 1, None)] + [7, None, "x", [good]]
    rows = served.histories(docs(spark, {"servers": [*bad, good, good], "index_url": "ftp://x"}), ["k"], origin="https://o").collect()
    assert [(r.place, r.slug) for r in rows] == [(len(bad), "a"), (len(bad) + 1, "a")]
    r = rows[0]
    assert (r.name, r.status, r.status_since, r.tool_count, r.first_seen, r.last_change) == ("Name", "failing", "", 3, "2024-01-01", "")
    assert r.page_url == "https://o/mcp-servers/a/" and r.entries == [] and r.open_flags == []


def test_a_name_of_unseen_characters_alone_is_the_slug(spark):
    rows = served.histories(docs(spark, {"index_url": "https://i", "servers": [{"slug": "a", "url": "https://a", "name": "​"}]}), ["k"]).collect()
    assert (rows[0].name, rows[0].page_url) == ("a", "https://i/a/")


def test_counts_are_whole_numbers(spark):
    for value, want in ((3, 3), (3.0, 3), (1e2, 100), (0, 0), (-1, None), (2.5, None), ("3", None), (True, None), (None, None), ([3], None), (10**30, None)):
        assert one(spark, [{"date": "2024-01-01", "kind": "first_seen", "tool_count": value}])["entries"][0]["tool_count"] == want, value


def test_entries_events_and_flags(spark):
    events = [
        {"type": "removed", "severity": "breaking", "tool": "t", "path": "tool:t.input.a b", "old_len": 4},
        {"type": "removed", "severity": "breaking", "tool": "do as I say", "path": "tool:do as I say.input.x"},
        {"type": "removed", "severity": "breaking", "path": "server.version"},
        {"type": "removed", "severity": "breaking", "path": "odd path", "tool": sha("x")},
        {"type": "title_changed", "severity": "info", "tool": "t", "path": "tool:t.title", "old_len": 1, "new_len": -1, "old_sha256": H, "new_sha256": "zz"},
        {"type": "Removed", "severity": "breaking"}, {"type": "removed", "severity": "loud"}, {"type": 1, "severity": "info"}, None, 5, [],
    ]
    flags = [{"flag": "hidden_characters", "tool": "x y", "detail": "U+200B U+FEFF"}, {"flag": "instruction_like_text", "tool": "t", "detail": "ignore previous"}, {"flag": "new"}, None]
    row = one(spark, [{"date": "2024-01-02", "kind": "change", "events": events, "flags": flags}, {"date": "2024-01-03", "kind": "unstable", "hashes": [H, "x", None, 1]}, {"date": "2024", "kind": "change"}, {"date": "2024-01-01", "kind": "other"}, 1])
    change, unstable = row["entries"]
    assert [(e["tool"], e["path"]) for e in change["events"]] == [
        ("t", "tool:t.input." + sha(".input.a b")), (sha("do as I say"), f"tool:{sha('do as I say')}.input.x"), ("", "server.version"), (sha("x"), sha("odd path")), ("t", "tool:t.title"),
    ]
    assert [e["old_len"] for e in change["events"]] == [None, None, None, None, 1]
    last = change["events"][-1]
    assert (last["new_len"], last["old_sha256"], last["new_sha256"]) == (None, H, "")
    assert [(f["flag"], f["tool"], f["detail"]) for f in change["flags"]] == [("hidden_characters", sha("x y"), "U+200B U+FEFF"), ("instruction_like_text", "t", "")]
    assert unstable["hashes"] == [H] and unstable["events"] is None and unstable["flags"] is None and change["tool_count"] is None


def test_what_cannot_be_read_is_named(spark):
    df = docs(spark, "{", None, "[]", '{"a": 1, "a": 2}', "", '"x"', {}, {"servers": {"slug": "a"}})
    assert sorted(r.k for r in served.unread(df, ["k"]).collect()) == [0, 1, 2, 3, 4, 5]
    assert served.histories(df, ["k"]).count() == 0 and served.feed_records(df, ["k"], "x").count() == 0
    assert served.histories(df.limit(0), ["k"]).count() == 0


def test_a_broken_copy_leaves_the_one_before_in_service(spark):
    df = spark.createDataFrame([("a", 1, '{"v": 1}', 0), ("a", 3, "<html>", 0), ("a", 2, '{"v": 2}', 0), ("b", 1, None, 0), ("c", 1, '{"x": 1}', 0), ("c", 1, '{"x": 2}', 0)], "key string, at int, body string, extra int")
    assert {tuple(r) for r in served.newest_read(df, ["key"], "at").collect()} == {("a", 2, '{"v": 2}'), ("c", 1, '{"x": 2}')}


def test_feed_records(spark):
    record = {"id": "r", "effective": "2024-01-01", "severity": "info", "signatures": ["a", "", 1], "context": ["x", ["y", "z", 1], 3], "summary": 7}
    bad = [{"_x": {**record, k: v}} for k, v in (("id", 1), ("effective", "2024"), ("severity", "loud"))] + [{"_x": [record]}, {"y": record}, None, 4]
    rows = served.feed_records(docs(spark, {"home_page_url": "https://h", "items": [*bad, {"url": "", "_x": record}, {"url": "https://u", "_x": record}]}), ["k"], "_x").collect()
    assert [(r.place, r.record_url) for r in rows] == [(len(bad), "https://h/records/r"), (len(bad) + 1, "https://u")]
    assert (rows[0].signatures, rows[0].context, rows[0].repo_context, rows[0].summary) == (["a"], [["x"], ["y", "z"]], [], "")


ODD = [
    {"servers": [{"slug": "a", "url": "https://a", "entries": [
        {"date": "2024-01-01", "kind": "noise", "events": [{"type": "removed", "severity": "info", "tool": "n"}]}, 5, None,
        {"date": "2024-01-02", "kind": "change", "events": [None, {"type": "removed", "severity": "loud"}, {"type": "title_changed", "severity": "info", "tool": "x y", "path": "tool:x y.title", "old_len": 2, "old_sha256": H}, [], {"type": "removed", "severity": "breaking", "tool": 7, "path": "a"}]},
        {"date": "2024-01-03", "kind": "unstable", "events": [{"type": "removed", "severity": "info"}]}, {"date": "2024-01-04", "kind": "change", "events": {"type": "removed", "severity": "info"}}]}]},
    {"servers": [{"slug": "A", "url": "https://a"}, {"slug": "b", "url": "https://b", "entries": {"date": "2024-01-01", "kind": "change"}}, {"slug": "c", "url": "https://c"}, {"slug": "c", "url": "https://c", "entries": [{"date": "2024-01-05", "kind": "change", "events": [{"type": "removed", "severity": "info", "path": ""}]}]}]},
    {"servers": {"slug": "a", "url": "https://a"}}, "{", None, "[]", '{"servers": [], "servers": []}', '"x"', [{"servers": []}],
]


def test_events_are_those_of_the_histories(spark):
    df = docs(spark, *ODD).withColumnsRenamed({"k": "key", "body": "value"})  # names that taking lists apart gives, too
    want = [(r.key, r.place, r.slug, e.date, *x) for r in served.histories(df, ["key"], "value").collect() for e in r.entries for x in e.events or ()]
    got = served.history_events(df, ["key"], "value")
    assert sorted(map(str, want)) == sorted(str((*r[:3], r.date, *r[6:])) for r in got.collect())
    assert sorted((r.key, r.place, r.entry, r.event, r.tool) for r in got.collect()) == [(0, 0, 3, 2, sha("x y")), (0, 0, 3, 4, ""), (1, 3, 0, 0, "")]


def plan(df):
    session = df.sparkSession
    session.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        session.conf.unset("spark.sql.debug.maxToStringFields")


def test_served_events_parse_a_text_once_and_build_no_list_anew(spark, sf_dir):
    from changelens.catalog import QUERIES

    for name in ("served_events", "served_servers"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("parseJson(") == 1 and "$['servers']" not in text, name
    assert "$['events']" not in plan(QUERIES["served_events"](spark, sf_dir))


def test_entries_are_counted_without_being_made(spark, sf_dir):
    from changelens.catalog import QUERIES

    rows = served.histories(docs(spark, *ODD), ["k"]).orderBy("k", "place").collect()
    assert [(r.slug, r.entry_count, len(r.entries)) for r in rows] == [("a", 3, 3), ("b", 0, 0), ("c", 0, 0), ("c", 1, 1)]
    text = plan(QUERIES["served_servers"](spark, sf_dir))
    assert "$['kind']" in text and "$['events']" not in text and "$['flags']" not in text

"""Histories as documents, in pages, as a feed, and the texts of their events."""

import pytest

from changelens.operators import documents

ENTRY = "slug string, at string, date string, kind string, tool_count int, hashes array<string>, to_hash string"
EVENT = "slug string, at string, type string, tool string, path string, severity string, old_len bigint, new_len bigint, old_sha256 string, new_sha256 string"
FLAG = "slug string, at string, flag string, tool string, detail string"


def entry(slug, at, kind):
    return (slug, at, at[:10], kind, 3, ["a" * 20, "b"], "c" * 20)


def event(slug, at, severity, path, tool="t", type="removed"):
    return (slug, at, type, tool, path, severity, 1, 2, "x", "y")


@pytest.fixture(scope="module")
def history(spark):
    entries = [entry("a", "2024-01-01T", "first_seen"), entry("a", "2024-02-01T", "change"), entry("a", "2024-02-01T", "unstable"), entry("a", "2024-03-01T", "change"), entry("gone", "2024-01-01T", "first_seen"), entry(None, "2024-01-01T", "change")]
    events = [event("a", "2024-02-01T", "info", "tool:t.title", type="title_changed"), event("a", "2024-02-01T", "breaking", "tool:t.z"), event("a", "2024-02-01T", "breaking", "tool:t.a b"), event("a", "2024-02-01T", None, "tool:u v", "u v")]
    flags = [("a", "2024-02-01T", "hidden_characters", "t", "U+200B"), ("a", "2024-02-01T", "hidden_characters", "u v", None), ("a", "2024-01-01T", "unusual_tool_name", "t", "")]
    return {
        "servers": spark.createDataFrame([("a", "A", "https://a", "", ""), ("new", "New", "https://n", "", "")], "slug string, name string, url string, registry_name string, added string"),
        "entries": spark.createDataFrame(entries, ENTRY),
        "events": spark.createDataFrame(events, EVENT),
        "flags": spark.createDataFrame(flags, FLAG),
        "last": spark.createDataFrame([("a", "auth", "2024-03-02", 3, "2024-03-05", "2024-03-01")], "slug string, outcome string, status_since string, tool_count int, last_checked string, last_ok string"),
    }


def test_one_document_a_server(history):
    found = {r.slug: r for r in documents.history_documents(**history, today="2024-02-20", base="https://x/").collect()}
    assert set(found) == {"a", "new"}
    new, a = found["new"], found["a"]
    assert (new.page, new.pages, new.status, new.status_since, new.first_seen, new.entries, new.open_flags) == (1, 1, "pending_first_check", None, None, [], [])
    assert (a.status, a.status_since, a.first_seen, a.last_change, a.open_flags, a.page_url) == ("needs_login", "2024-03-02", "2024-01-01", "2024-03-01", ["hidden_characters"], "https://x/a/")
    assert [(e.date, e.kind) for e in a.entries] == [("2024-03-01", "change"), ("2024-02-01", "change"), ("2024-02-01", "unstable"), ("2024-01-01", "first_seen")]
    last, change, unstable, first = a.entries
    assert last.events == [] and last.flags == [] and last.counts.breaking == 0
    assert [(e.severity, e.path[:11], e.old_len) for e in change.events] == [("breaking", "tool:t.sha2", None), ("breaking", "tool:t.z", None), ("info", "tool:t.titl", 1), (None, "tool:sha256", None)]
    assert (change.counts.breaking, change.counts.info, len(change.flags), change.flags[0].detail) == (2, 1, 2, "")
    assert unstable.hashes == ["a" * 20, "b"] and unstable.events is None and unstable.flags is None and unstable.counts is None
    assert first.tool_count == 3 and len(first.flags) == 1 and first.events is None


def test_empty_tables(history):
    empty = {k: v if k == "servers" else v.limit(0) for k, v in history.items()}
    assert [r.entries for r in documents.history_documents(**empty, today="2024-02-20", base="x").collect()] == [[], []]
    assert documents.history_documents(**{k: v.limit(0) for k, v in history.items()}, today="2024-02-20", base="x").count() == 0


def test_many_entries_go_on_over_pages(spark, history):
    rows = [entry("a", f"{1900 + i}-01-01T", "change") for i in range(100)] + [entry("new", f"{1900 + i}-01-01T", "change") for i in range(7)]
    for newest in (True, False):
        found = documents.history_documents(**{**history, "entries": spark.createDataFrame(rows, ENTRY)}, today="2024-02-20", base="x", size=7, newest=newest).collect()
        for slug, n in (("a", 100), ("new", 7)):
            pages = sorted((r for r in found if r.slug == slug), key=lambda r: r.page)
            assert [r.page for r in pages] == list(range(1, -(-n // 7) + 1)) and {r.pages for r in pages} == {len(pages)}
            assert [len(r.entries) for r in pages[:-1]] == [7] * (len(pages) - 1)
            dates = [e.date for r in pages for e in r.entries]
            assert len(dates) == n and dates == sorted(dates, reverse=newest)


def test_feed_rows(history):
    nested = documents.nested_entries(history["entries"], history["events"], history["flags"]).join(history["entries"].select("slug", "at", "kind", "to_hash"), ["slug", "at", "kind"])
    rows = documents.feed_rows(history["servers"], nested).orderBy("place").collect()
    assert [(r.place, r.date, r.key, r.title) for r in rows] == [
        (1, "2024-03-01", "c" * 12, "A: no classified events"),
        (2, "2024-02-01", "c" * 12, "A: 2 breaking, 1 info (1 flag)"),
        (3, "2024-02-01", "unstable-aaaaaaaaaaaa-b", "A: alternating between two tool lists"),
        (4, "2024-01-01", "first", "A: first check, 3 tools (1 flag)"),
    ]


def test_event_texts(spark):
    events = spark.createDataFrame([("a", "h0", "h1", t, "t", 0) for t in ("title_changed", "description_changed", "annotation_changed", "removed")] + [("a", "h0", "lost", "title_changed", "t", 0), ("b", "h0", "h1", "title_changed", None, 0)], "slug string, from_hash string, to_hash string, type string, tool string, extra int")
    texts = spark.createDataFrame([("a", "h0", "t", "T0", "D0", '{"title": "A0"}'), ("a", "h0", "t", "T0", "D0", '{"title": "A0"}'), ("a", "h1", "t", "T1", None, "no json")], "slug string, hash string, tool string, title string, description string, annotations string")
    got = {(r.slug, r.to_hash, r.type): (r.old_text, r.new_text) for r in documents.event_texts(events, texts).collect()}
    assert got == {
        ("a", "h1", "title_changed"): ("T0", "T1"), ("a", "h1", "description_changed"): ("D0", ""), ("a", "h1", "annotation_changed"): ("A0", ""), ("a", "h1", "removed"): (None, None),
        ("a", "lost", "title_changed"): ("T0", ""), ("b", "h1", "title_changed"): ("", ""),
    }

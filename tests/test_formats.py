"""Records and watch lists as data sources."""

import datetime

import pytest

from changelens.sources import formats, records

RECORD = """
id: {id}
vendor: V
kind: model
severity: breaking
effective: 2024-01-0{n}
signatures: [gpt-4, 4]
context: [a, [b, c]]
evidence: [plain text, {{url: "https://e", text: other}}]
source_url: https://s
verified: true
verified_on: soon
"""


@pytest.fixture(scope="module")
def reader(spark):
    formats.register(spark)
    return lambda name, path, **options: spark.read.format(name).options(**options).load(str(path))


def test_records_in_order_over_groups_of_files(reader, tmp_path):
    for i, name in enumerate(("b.yml", "a.yaml", "a.yml", "c.yml", ".hidden.yml", "note.txt")):
        (tmp_path / name).write_text(RECORD.format(id=name, n=i + 1))
    df = reader("change_records", tmp_path, filesPerPartition=2)
    assert df.rdd.getNumPartitions() == 2
    rows = df.orderBy("load_ordinal").collect()
    assert [(r.load_ordinal, r.id) for r in rows] == [(0, "a.yml"), (1, "b.yml"), (2, "c.yml"), (3, "a.yaml")]
    r = rows[0]
    assert (r.effective, r.verified_on, r.verified, r.illustrative) == (datetime.date(2024, 1, 3), None, True, False)
    assert (r.signatures, r.context, r.files, r.error) == (["gpt-4", "4"], [["a"], ["b", "c"]], [], None)
    assert [tuple(e) for e in r.evidence] == [("https://s", "plain text"), ("https://e", "other")]


def test_the_same_rows_as_the_folder_reader(spark, reader, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.yml").write_text(RECORD.format(id=i, n=i + 1))
    (tmp_path / "x.yml").write_text("a: [")
    got = reader("change_records", tmp_path, filesPerPartition=4)
    want = records.read(spark, str(tmp_path)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.where("error is null and severity = 'breaking'").count() == 9


def test_malformed_empty_and_long_files(reader, tmp_path):
    texts = {"a": "a: [", "b": "- 1", "c": "", "d": "text", "e": "signatures: 5", "f": f"id: f\ndetail: {'x' * 2_000_000}"}
    for name, text in texts.items():
        (tmp_path / f"{name}.yml").write_text(text)
    (tmp_path / "g.yml").write_bytes(b"id: \xff\n")
    rows = reader("change_records", tmp_path).orderBy("load_ordinal").collect()
    assert [r.error is not None for r in rows] == [True, True, False, True, True, False, False]
    assert all(r.id is None for r in rows if r.error) and len(rows[5].detail) == 2_000_000 and rows[6].id == "�"


def test_empty_and_missing_folders(reader, tmp_path):
    assert reader("change_records", tmp_path).count() == 0 and reader("watch_list", tmp_path).count() == 0
    with pytest.raises(Exception, match="missing"):
        reader("change_records", tmp_path / "missing").count()


def test_watch_list(reader, tmp_path):
    (tmp_path / "a.yml").write_text("""
servers:
  - {slug: one, name: One, url: "https://one.x/mcp", registry_name: r/one, added: 2024-01-02}
  - {slug: one, name: Again, url: "https://one.x"}
  - {slug: Two, name: Two, url: "https://two"}
  - {slug: three, name: Three, url: "http://three"}
  - {slug: four, name: "", url: "https://four"}
  - {slug: five, name: Five, url: "https://five", added: soon}
  - {slug: six, name: Six, url: "https://", extra: 1}
  - seven
  -
  - {slug: 8, name: 9, url: "https://eight"}
""")
    (tmp_path / "b.yml").write_text("servers: {a: 1}")
    (tmp_path / "c.yml").write_text("servers: [")
    (tmp_path / "d.yml").write_text("servers:\n")
    rows = reader("watch_list", tmp_path).orderBy("file", "place").collect()
    assert [(r.slug, r.error) for r in rows[:10]] == [
        ("one", None), ("one", "duplicate slug"), ("Two", "bad slug"), ("three", "url must be https"), ("four", "a name of 1 to 100 characters"),
        ("five", "added is no day"), ("six", "url must be https"), (None, "no mapping"), (None, "no mapping"), ("8", None),
    ]
    assert (rows[0].registry_name, rows[0].added, rows[1].registry_name) == ("r/one", datetime.date(2024, 1, 2), "")
    assert [(r.file[-5:], r.slug, r.error.split(":")[0]) for r in rows[10:]] == [("b.yml", None, "TypeError"), ("c.yml", None, "ParserError")]

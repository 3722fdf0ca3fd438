import hashlib
import os
from collections import Counter

import public_tokenizers as P
import pytest

from changelens.llm import alignment, queries

SCHEMA = "doc_id long, text string, n_a string, row string"


@pytest.fixture(scope="module")
def files(spark):
    return alignment.read_tokenizers(spark, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """The libraries on whole texts: ids and bytes of both tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = alignment.byte_of_char()

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        good = b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if text and good else ([], [], [], [])

    return both


def plain_links(texts, plain):
    """What the query returns, by walking both token lists."""
    docs = []
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = plain(text or "")
        groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        while i < len(ids_a):
            i0, j0 = i, j
            at_a, i = at_a + len(bytes_a[i]), i + 1
            at_b, j = at_b + len(bytes_b[j]), j + 1
            while at_a != at_b:
                if at_a < at_b:
                    at_a, i = at_a + len(bytes_a[i]), i + 1
                else:
                    at_b, j = at_b + len(bytes_b[j]), j + 1
            groups.append(f"{','.join(map(str, ids_a[i0:i]))}|{','.join(map(str, ids_b[j0:j]))}")
            links.append((ids_a[i - 1], ids_b[j - 1]))
        docs.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(x for d in docs for x in d[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(a, b, len(g), len(x), sum(counts[y] == most[y[1]] for y in x), sum(counts[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in docs]


EDGES = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\ta\t b", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a▁b", "éß 你好 \U0001f600\U0001f600 x", "it's it 's we'll", "x y 　z", "\x1c a\x1db \x85 c", "\x00a b", "a" * 3000, "ab " * 4000, "\r\n\r\n  x", "1234567 890", "é a", "ﬁ Ａ", "a", "a"]


def test_edges_against_the_libraries(spark, files, plain):
    got = alignment.document_links(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(EDGES)], SCHEMA), files, P.PATTERN).orderBy("doc_id").collect()
    results = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert got[0].asDict().keys() == {"doc_id", "row", *results}
    assert [r.row for r in got] == ["y"] * len(EDGES)
    assert [tuple(r[c] for c in results) for r in got] == plain_links(EDGES, plain)


def test_query_against_the_libraries(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op13_alignment(spark, sf_dir).orderBy("doc_id").collect()
    want = plain_links([r.text for r in docs], plain)
    assert [tuple(r)[1:] for r in got] == want and [r.doc_id for r in got] == [r.doc_id for r in docs]


def test_rows_with_one_id_and_empty_tables(spark, files, monkeypatch):
    rows = [(7, "a b", None, None), (7, "c", None, None), (None, "a b", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = alignment.document_links(df, files, P.PATTERN)
    assert sorted(tuple(r)[2:] for r in got.collect()) == sorted(tuple(r)[2:] for r in got.collect()) and got.count() == 3
    whole = sorted(map(str, got.collect()))
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert sorted(map(str, alignment.document_links(df, files, P.PATTERN).collect())) == whole
    assert alignment.document_links(df.limit(0), files, P.PATTERN).count() == 0


def test_groups_are_kept_as_lists(spark, files):
    row = alignment.align(spark.createDataFrame([(1, "hello worlds")], "doc_id long, text string"), files, P.PATTERN).head()
    assert len(row.groups) == row.n_groups == len(row.a) == len(row.b) and row.groups[-1].endswith(str(row.b[-1]))


def test_a_small_cache_gives_the_same(plain, monkeypatch):
    with open(P.path("byte_bpe_50k.json"), "rb") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        both = alignment.Tokenizers(a.read(), b.read(), P.PATTERN)
    texts = ["one two three", "three two", "four \n\n five"]
    whole = both.texts(texts).to_pylist()
    monkeypatch.setattr(alignment, "CACHE_STRETCHES", 1)
    monkeypatch.setattr(alignment, "PART_CHARS", 10)
    assert [both.texts([t]).to_pylist()[0] for t in texts] == whole and whole[0]["a"] == plain(texts[0])[0]

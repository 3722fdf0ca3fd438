import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from changelens.llm import bpe
from changelens.llm.queries import op3_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DECODER = bpe.decoder(open(PATH, "rb").read())
ENCODER = bpe.Encoder(bpe.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN))


def check(texts):
    flat, counts = ENCODER.texts(texts)
    want = [REFERENCE.encode_ordinary(t or "") for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]
    assert DECODER.decode(flat).tobytes() == "".join(t or "" for t in texts).encode()


def test_hard_texts():
    check([None, "", " ", "\n\n", "a" * 5000, "ab" * 700 + "é" * 600, "x  y\t\tz", "日本語テキスト🙂🙂", "<|endoftext|>", "don't WE'LL 123456", "aaaaaaa bbbb aaaaaaa"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(texts):
    check(texts)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = REFERENCE.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    ranks = bpe.read_ranks(spark, PATH)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "id long, text string").withColumn("ids", bpe.F.lit("clash"))
    out = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks)
    assert sorted((r.id, len(r.ids), bytes(r.decoded)) for r in out.collect()) == [(1, 0, b""), (2, 0, b""), (3, 2, b"a b"), (3, 2, b"a b")]
    assert bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_round_trip(spark):
    ranks = bpe.read_ranks(spark, PATH)
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b🙂", 5)], "id long, text string, exact int")
    got = bpe.round_trip(df, ranks, public_tokenizers.PATTERN).collect()
    assert [(r.id, list(r.ids), r.exact) for r in got] == [(1, [], True), (2, [], True), (3, REFERENCE.encode_ordinary("a b🙂"), True)]

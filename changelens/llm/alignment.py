"""Which tokens of two tokenizers stand for the same bytes of a text.

A is a byte-level BPE (a JSON file), B a SentencePiece model that puts a space before a text. Both read
space+text; byte offsets at which tokens of both end cut a text into groups, and tokens of A and B that end together are linked.

Method: Python only tokenises (``tokens``): ids, byte ends, and each byte's token. From there on Spark's higher-order functions do all:
``array_intersect`` of the ends gives the cuts, ``transform`` the token that ends at each (looked up by its last byte, so nothing is searched for and
the work grows with the text's length), ``transform``, ``slice`` and ``zip_with`` the groups and links.
Links are counted over all documents by id pair, which partial sums combine before the shuffle.

Tokenising: neither tokenizer joins across a single space between two other characters (A's pattern begins a piece there; no piece of B has
a space after another character, which is checked), so texts are split there, and a worker tokenises each stretch once.

Defined results: a text that is null or empty, or whose tokens' bytes aren't those of space+text (a literal U+2581, for one),
has no tokens: zeros and an empty column of groups. Every row counts by itself, whatever its id or text. Other columns are kept, but for those named like a result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, let, offsets, take_ranges, written

#: Id pairs up to which they are broadcast (three numbers each); more of them are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Stretches, and their characters, that a worker remembers before it starts afresh.
CACHE_STRETCHES, CACHE_CHARS = 200_000, 8_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters of texts that are put into arrays at a time.
PART_CHARS = 500_000
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
TOKENS = "struct<a:array<int>,a_ends:array<int>,a_at:array<int>,b:array<int>,b_ends:array<int>,b_at:array<int>>"


def byte_of_char() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as characters: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_tokenizers(spark: SparkSession, a_path: str, b_path: str):
    """A broadcast of both files; their size is that of the vocabularies, whatever the data."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


class Tokenizers(dict):
    """Stretch -> row of the arrays that hold its tokens; new stretches get the next rows and wait in ``fresh``."""

    def __init__(self, a_file: bytes, b_file: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        made, chars = json.loads(a_file), byte_of_char()
        special = {t["content"] for t in made["added_tokens"]}
        a_bytes = {i: bytes(map(chars.__getitem__, t)) for t, i in made["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of B has a space after another character, so texts can't be split at spaces")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = {"a": [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], "b": b_bytes}
        self.lengths = {side: np.array([len(t) for t in known], np.int64) for side, known in self.bytes.items()}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars, self.fresh = 0, []
        none = lambda kind: np.zeros(0, kind)
        self.good, self.size = none(bool), none(np.int64)
        self.flat = {side: (none(np.int32), none(np.int32)) for side in "ab"}  # ids, and ends within the stretch
        self.starts, self.counts = ({side: none(np.int64) for side in "ab"} for _ in range(2))

    def __missing__(self, stretch: str) -> int:
        self[stretch] = row = len(self)
        self.fresh.append(stretch)
        self.chars += len(stretch)
        return row

    def _learn(self) -> None:
        """Tokens of the new stretches, as arrays end to end."""
        said = [b" " + s.encode() for s in self.fresh]
        size = np.array([len(w) for w in said], np.int64)
        found = self.b.encode(self.fresh, num_threads=1)
        tokens = {"a": self._all_a(said), "b": (np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64))}
        good = np.ones(len(said), bool)
        for side, (ids, counts) in tokens.items():
            known, lengths = self.bytes[side], self.lengths[side][ids]
            ends, firsts = offsets(lengths), offsets(counts)
            bounds = ends[firsts]
            same = np.diff(bounds) == size
            joined = b"".join(map(known.__getitem__, ids.tolist()))
            if not same.all() or joined != b"".join(said):
                good &= same & np.array([joined[x:y] == w for x, y, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), said, strict=True)])
            self.starts[side] = np.concatenate([self.starts[side], len(self.flat[side][0]) + firsts[:-1]])
            self.counts[side] = np.concatenate([self.counts[side], counts])
            within = ends[1:] - np.repeat(bounds[:-1], counts)
            self.flat[side] = tuple(np.concatenate([old, new.astype(np.int32)]) for old, new in zip(self.flat[side], (ids, within), strict=True))
        self.good = np.concatenate([self.good, good])
        self.size = np.concatenate([self.size, size])
        self.fresh = []

    def _all_a(self, said: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of the stretches, and how many each has. Those without white space at an end are one text, whose tokens are dealt out by their ends."""
        plain = np.fromiter((not (s[0].isspace() or s[-1].isspace()) for s in self.fresh), bool, len(said))
        counts, parts = np.zeros(len(said), np.int64), [None] * len(said)
        for i in np.flatnonzero(~plain).tolist():
            parts[i] = self.a.encode_ordinary(said[i].decode())
        for i, x in enumerate(parts):
            counts[i] = len(x) if x is not None else 0
        together = [said[i] for i in np.flatnonzero(plain).tolist()]
        ids = np.array(self.a.encode_ordinary(b"".join(together).decode()) if together else [], np.int32)
        ends = np.cumsum(self.lengths["a"][ids])
        counts[plain] = np.diff(np.searchsorted(ends, offsets(np.array([len(w) for w in together], np.int64))[1:], "right"), prepend=0)
        if plain.all():
            return ids, counts
        places = offsets(counts)
        out = np.zeros(places[-1], np.int32)
        out[np.repeat(plain, counts)] = ids
        for i in np.flatnonzero(~plain).tolist():
            out[places[i] : places[i + 1]] = parts[i]
        return out, counts

    def texts(self, texts: list[str | None]) -> pa.StructArray:
        if len(self) > CACHE_STRETCHES or self.chars > CACHE_CHARS:
            self.reset()
        stretches = [_CUT.split(t) if t else [] for t in texts]
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(stretches)), np.int64)
        if self.fresh:
            self._learn()
        bounds = offsets(np.array([len(s) for s in stretches], np.int64))
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        bad = np.bincount(text[~self.good[rows]], minlength=len(texts)) > 0
        rows, text = rows[~bad[text]], text[~bad[text]]
        before = offsets(self.size[rows])[:-1]  # bytes of the batch before each stretch
        first = np.searchsorted(text, np.arange(len(texts)))
        before = before - before[first[text]] if len(rows) else before
        listed = lambda values, counts: pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(values.astype(np.int32)))
        out = {}
        for side in "ab":
            counts = self.counts[side][rows]
            ids, ends = (take_ranges(x, self.starts[side][rows], counts) for x in self.flat[side])
            each = np.bincount(text, counts, len(texts)).astype(np.int64)
            number = np.arange(len(ids)) - np.repeat(offsets(each)[:-1], each)
            size = np.bincount(text, self.size[rows], len(texts)).astype(np.int64)
            # a byte's place is counted from 1, as ends are
            at = np.insert(np.repeat(number, self.lengths[side][ids]), offsets(size)[:-1], 0)
            out |= {side: listed(ids, each), f"{side}_ends": listed(ends + np.repeat(before, counts), each), f"{side}_at": listed(at, size + 1)}
        return pa.StructArray.from_arrays([*out.values()], [*out])


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in parts of about ``PART_CHARS``; a longer text is a part of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > PART_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    yield part


_made: dict[str, Tokenizers] = {}


def _of_worker(files: tuple[bytes, bytes], pattern: str) -> Tokenizers:
    key = hashlib.sha256(b"".join([*files, pattern.encode()])).hexdigest()
    if key not in _made:
        _made[key] = Tokenizers(*files, pattern)
    return _made[key]


def tokens(text: Column, files, pattern: str) -> Column:
    """Ids, byte ends and each byte's token number of both tokenizers for space+text. files: from ``read_tokenizers``; pattern: how A splits texts."""

    @F.arrow_udf(TOKENS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = _of_worker(files.value, pattern)
        for batch in batches:
            yield pa.concat_arrays([both.texts(part) for part in _parts(batch.to_pylist())])

    return of(text)


def last_tokens(token: Column, ends: Column, side: str) -> Column:
    """For each end of a group the number of the side's token that ends there."""
    return let(token[f"{side}_at"], lambda at: F.transform(ends, lambda e: F.get(at, e)))


def parts(ids: Column, last: Column) -> Column:
    """For each group a side's ids, parted by commas. last: of ``last_tokens``."""
    firsts = F.slice(F.concat(F.array(F.lit(0)), F.transform(last, lambda i: i + 1)), F.lit(1), F.size(last))
    one, two = (lambda all_, a, b: F.get(all_, a)), (lambda all_, a, b: F.concat(F.get(all_, a), F.lit(","), F.get(all_, b)))
    part = lambda all_, a, b: F.when(a == b, one(all_, a, b)).when(a + 1 == b, two(all_, a, b)).otherwise(F.array_join(F.slice(all_, a + 1, b - a + 1), ","))
    return let(ids.cast("array<string>"), lambda all_: F.zip_with(firsts, last, lambda a, b: part(all_, a, b)))


def linked(ids: Column, last: Column) -> Column:
    """A side's ids that are linked, group by group: those whose tokens end together."""
    return let(ids, lambda all_: F.transform(last, lambda i: F.get(all_, i)))


def align(docs: DataFrame, files, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with the lists ``a`` and ``b`` of linked ids, ``n_a``, ``n_b``, ``n_groups`` and the ``groups``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), tokens(F.col(text), files, pattern).alias("token"))
    token, ends = F.col("token"), F.col("ends")
    rows = rows.withColumn("ends", F.array_intersect(token["a_ends"], token["b_ends"]))
    rows = rows.select("row", "token", F.size("ends").cast("long").alias("n_groups"), *[last_tokens(token, ends, s).alias(s) for s in "ab"])
    both = F.zip_with(parts(token["a"], F.col("a")), parts(token["b"], F.col("b")), lambda x, y: F.concat(x, F.lit("|"), y))
    results = [*[F.size(token[s]).cast("long").alias(f"n_{s}") for s in "ab"], "n_groups", both.alias("groups"), *[linked(token[s], F.col(s)).alias(s) for s in "ab"]]
    names = {"a", "b", "n_a", "n_b", "n_groups", "groups", text.lower()}
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in names], *results)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): how many links hold an id pair, and whether none of its B id has more."""
    counts = aligned.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("links"))
    most = F.max("links").over(Window.partitionBy("b"))
    return counts.withColumn("best", F.col("links") == most)


def count_links(aligned: DataFrame, pairs: DataFrame, row: str) -> DataFrame:
    """(row, n_links, n_best, count_sum) of each row with links, found by a key of the row."""
    small = pairs.count() <= BROADCAST_PAIRS
    links = aligned.select(row, F.inline(F.arrays_zip("a", "b"))).join(F.broadcast(pairs) if small else pairs, ["a", "b"])
    return links.groupBy(row).agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("links").alias("count_sum"))


def document_links(docs: DataFrame, files, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The aligned documents are written once, with their groups as digests, and read twice: for the counts and for the sums.
    """
    results = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    others = [c for c in docs.columns if c.lower() not in (*results, text.lower())]
    found = align(docs.select(F.struct(*others).alias("row"), F.col(text).alias("text")), files, pattern)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.array_join("groups", ";"), 256))
    keep = docs.sparkSession.conf.get(BATCH_BYTES)
    docs.sparkSession.conf.set(BATCH_BYTES, str(1 << 20))  # a text comes back as some ten times its bytes
    found = written(found.withColumns({"groups_sha256": digest, "id": F.monotonically_increasing_id()}).drop("groups"), "aligned")
    docs.sparkSession.conf.set(BATCH_BYTES, keep)
    pairs = checkpoint(pair_counts(found))
    sums = count_links(found, pairs, "id")
    joined = found.drop("a", "b").join(sums, "id", "left").na.fill(0, ["n_links", "n_best", "count_sum"])
    return joined.select(*[F.col("row").getField(c).alias(c) for c in others], *results)

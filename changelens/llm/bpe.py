"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

``encode`` turns a text column into ``array<int>`` token ids, ``decode`` turns
ids back into bytes. The vocabulary is a rank file (base64 token, rank) whose
path is a parameter; its bytes (a fixed size) go to the tasks in a broadcast.

Method: a text is split by the vocabulary's pattern; each distinct piece that
isn't a token itself becomes one row of a padded matrix, in a bucket of rows of
like length. In every round each row merges its leftmost pair of least rank,
found by a hashed lookup of (left id, right id); rows close up by one place and
rows without a pair leave the matrix. One row of a bucket has no gain from the
matrix, and its rounds cost its length each, so pieces of over ``LONG`` bytes
keep their pairs in a heap instead, which makes the same merges in the same
order.

Defined results: null text counts as empty, an empty text has no ids and
decodes to no bytes; ids outside the vocabulary raise an error. An existing
column with the name of the output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, take_ranges

#: Sizes of the padded buckets; a longer piece takes the heap.
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 512)
LONG = BUCKETS[-1]
#: Pieces that a worker remembers between batches before it starts afresh.
CACHE_PIECES = 100_000
#: Pieces that are put into arrays at a time.
BLOCK_PIECES = 50_000
NO_PAIR = np.iinfo(np.int32).max


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of the joined token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(8, int(len(left) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NO_PAIR, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            slots = at[todo]
            free = self.keys[slots] == -1
            first = np.zeros(len(todo), bool)  # one of the keys that want the same free slot gets it
            first[np.unique(slots, return_index=True)[1]] = True
            won = free & first
            self.keys[slots[won]], self.ids[slots[won]] = keys[todo[won]], joined[todo[won]]
            todo = todo[~won]
            taken = self.keys[at[todo]] != -1
            at[todo[taken]] = (at[todo[taken]] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, NO_PAIR where the pair doesn't join; ids below 0 are padding."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ids[at], NO_PAIR)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        out[(left < 0) | (right < 0)] = NO_PAIR
        return out


def read_tokens(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}


class Decoder:
    """The bytes of all tokens end to end."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = offsets(self.lengths)[:-1]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids, as uint8."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("token id outside the vocabulary")
        return take_ranges(self.bytes, self.starts[ids], self.lengths[ids])


class Vocabulary:
    """Ranks of a byte-level BPE, with the tables that encoding and decoding look up."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = read_tokens(rank_file)
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, joined = (np.array(x, np.int64) for x in zip(*triples, strict=True))
        self.pairs = PairTable(left, right, joined.astype(np.int32))
        self._triples = left, right, joined

    @cached_property
    def pair_ids(self) -> dict[tuple[int, int], int]:
        """The pairs once more for the heap; only texts with a very long piece need them."""
        return {(a, b): c for a, b, c in zip(*(x.tolist() for x in self._triples), strict=True)}

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some distinct pieces."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(piece) > LONG:
                out[i] = self.merge_long(piece)
            else:
                by_size.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(i)
        for size, rows in by_size.items():
            lengths = np.array([len(pieces[i]) for i in rows])
            matrix = np.full((len(rows), size), -1, np.int32)
            matrix[np.arange(size) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
            for i, ids in zip(rows, self.merge(matrix), strict=True):
                out[i] = ids
        return out

    def merge(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Rounds of one merge a row, until no row has a pair."""
        out: list[np.ndarray | None] = [None] * len(matrix)
        rows = np.arange(len(matrix))
        joined = self.pairs.find(matrix[:, :-1].ravel(), matrix[:, 1:].ravel()).reshape(len(matrix), -1)
        while len(rows):
            at = joined.argmin(axis=1)
            best = joined[np.arange(len(rows)), at]
            if (done := best == NO_PAIR).any():
                for i, ids in zip(rows[done], matrix[done], strict=True):
                    out[i] = ids[ids >= 0]
                rows, matrix, joined, at, best = rows[~done], matrix[~done], joined[~done], at[~done], best[~done]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            matrix[every, at] = best
            columns = np.arange(matrix.shape[1] - 1)
            moved = columns + (columns > at[:, None])
            matrix = np.take_along_axis(matrix, moved, 1)
            if matrix.shape[1] == 1:
                joined = np.full((len(rows), 1), NO_PAIR, np.int32)
                continue
            joined = np.take_along_axis(joined, moved[:, :-1] if matrix.shape[1] > 1 else moved, 1)
            right = np.flatnonzero(at < matrix.shape[1] - 1)
            joined[right, at[right]] = self.pairs.find(matrix[right, at[right]], matrix[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            joined[left, at[left] - 1] = self.pairs.find(matrix[left, at[left] - 1], matrix[left, at[left]])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(j, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (j := self.pair_ids.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            joined, i, left, right = heapq.heappop(heap)
            k = after[i]
            if ids[i] != left or k >= len(ids) or ids[k] != right:
                continue  # one of the two has merged since
            ids[i], ids[k], after[i] = joined, -1, after[k]
            if after[i] < len(ids):
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else len(ids)
                if b < len(ids) and (j := self.pair_ids.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (j, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], np.int32)


class Encoder(dict):
    """Piece text -> row of the arrays; pieces that are new get the next rows and wait in ``fresh``."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = row = len(self)
        self.fresh.append(piece)
        return row

    def block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces end to end, and how many each has."""
        if len(self) > CACHE_PIECES:
            self.reset()
        rows = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.fresh:
            new = self.vocabulary.encode_pieces([p.encode() for p in self.fresh])
            lengths = np.array([len(x) for x in new], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + offsets(lengths)[:-1]])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, *new])
            self.fresh = []
        lengths = self.lengths[rows]
        return take_ranges(self.flat, self.starts[rows], lengths), lengths

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and how many each has."""
        found, out, counts, waiting = self.vocabulary.pieces.finditer, [], np.zeros(len(texts), np.int64), []
        split = self.vocabulary.pieces.findall
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if waiting:
                ids, lengths = self.block(waiting)
                ends = offsets(lengths)
                at = 0
                for doc, n in owners:
                    counts[doc] += ends[at + n] - ends[at]
                    at += n
                out.append(ids)
                waiting.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) < BLOCK_PIECES:
                pieces = split(text)
                waiting += pieces
                owners.append((i, len(pieces)))
            else:  # a very long text comes in blocks of its own
                n = 0
                for match in found(text):
                    waiting.append(match.group())
                    n += 1
                    if len(waiting) >= BLOCK_PIECES:
                        owners.append((i, n))
                        flush()
                        n = 0
                owners.append((i, n))
            if len(waiting) >= BLOCK_PIECES:
                flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts


_made: dict[str, Encoder | Decoder] = {}


def _of_worker(kind: str, rank_file: bytes, pattern: str = "") -> Encoder | Decoder:
    """A worker makes each table once."""
    key = f"{kind} {hashlib.sha256(rank_file + pattern.encode()).hexdigest()}"
    if key not in _made:
        _made[key] = Encoder(Vocabulary(rank_file, pattern)) if kind == "encoder" else decoder(rank_file)
    return _made[key]


def decoder(rank_file: bytes) -> Decoder:
    ranks = read_tokens(rank_file)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Decoder(tokens)


def read_ranks(spark: SparkSession, path: str):
    """A broadcast of a rank file; its size is that of the vocabulary, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of a text column. ranks: from ``read_ranks``."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _of_worker("encoder", ranks.value, pattern)
        for batch in batches:
            flat, counts = encoder.texts(batch.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(flat))

    return df.withColumn(out, ids(F.col(text)))


def round_trip(df: DataFrame, ranks, pattern: str, text: str = "text", out: str = "ids", exact: str = "exact") -> DataFrame:
    """Add the ids, and whether they decode to the text's very bytes; both by one worker, which sends no bytes back."""

    @F.arrow_udf("struct<ids:array<int>,exact:boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, known = _of_worker("encoder", ranks.value, pattern), _of_worker("decoder", ranks.value)
        for batch in batches:
            texts = batch.to_pylist()
            flat, counts = encoder.texts(texts)
            ends = offsets(counts)
            exact_ = [known.decode(flat[a:b]).tobytes() == (t or "").encode() for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.StructArray.from_arrays([ids, pa.array(exact_, pa.bool_())], ["ids", "exact"])

    named = df.withColumn("_both", both(F.col(text)))
    return named.withColumns({out: F.col("_both.ids"), exact: F.col("_both.exact")}).drop("_both")


def decode(df: DataFrame, ranks, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give no bytes."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _of_worker("decoder", ranks.value)
        for batch in batches:
            counts = np.diff(batch.offsets.to_numpy()) if not batch.null_count else batch.value_lengths().fill_null(0).to_numpy()
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            sizes = offsets(known.lengths[flat])
            data = known.decode(flat).tobytes()
            ends = sizes[offsets(counts)]
            yield pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return df.withColumn(out, decoded(F.col(ids)))

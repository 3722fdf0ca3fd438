"""Media columns: chroma fingerprints of recordings, and their alignment.

``fingerprints`` turns a binary column of WAV files into arrays of 32-bit integers,
``search`` aligns a stated set of recordings with all others.

Method: frames of ``FRAME`` seconds every ``HOP`` seconds are transformed, the energy of
each pitch class is summed and a frame scaled to length one. Over the integral image
of frames and classes (twelve twice, so that filters wrap around) each of sixteen
box filters gives two bits (Gray code of its value against minus its step, 0 and its step) for
each stretch of ``SPAN`` frames; they are packed into an integer for each frame. A query
and a recording that share integers vote for the offsets at which they do (a run of
equal integers votes once, with its begin); at each offset with a vote the
bits that differ over the overlap are counted. Recordings that match without one equal integer at the right offset are
not found; tests measure how few these are against all offsets of all pairs. They match if the share of these bits is
``MAX_ERROR`` or less over ``MIN_OVERLAP`` integers or, if either has fewer, all of the
shorter one.

Recordings with equal fingerprints are one to begin with. Queries and recordings are
dealt to blocks of bounded size; each pair of blocks is one group, in which votes are
counted for one query at a time. A group returns a row for each query with
matches, never the pairs.

Defined results: null, empty and undecodable files and those of less than ``SPAN``
frames have an empty fingerprint, which matches nothing; samples of 8, 16 or 32 bits
and any number of channels and any rate are read, channels are averaged. A query
doesn't match its own row; repeated rows match each other. Columns of the input stay
in ``fingerprints``, but for one with the name of the output.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sorted_groups

FRAME, HOP, SPAN = 0.512, 0.128, 8
#: Steps of the four kinds of filters: about half of all values lie between minus and plus a step.
STEPS = (0.07, 0.025, 0.06, 0.12)
LOW_HZ, HIGH_HZ = 60.0, 2000.0
MAX_ERROR, MIN_OVERLAP = 0.15, 12
QUERY_BLOCK, BLOCK = 1024, 2048


def decode(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, and their rate; none if the file can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), 1
    if width not in (1, 2, 4) or not rate:
        return np.zeros(0), 1
    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
    samples = np.frombuffer(raw, kind, len(raw) // (width * channels) * channels).astype(np.float64)
    samples = samples / 2 ** (8 * width - 1) - (1 if width == 1 else 0)
    return samples.reshape(-1, channels).mean(axis=1), rate


@lru_cache
def _classes(size: int, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window, the bins in range, and a matrix from these bins to pitch classes (A is 0)."""
    hz = np.fft.rfftfreq(size, 1 / rate)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12
    return np.hanning(size), used, (pitch[:, None] == np.arange(12)).astype(np.float64)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch classes, each of length one or, in silence, zero."""
    size, hop = max(2, round(FRAME * rate)), max(1, round(HOP * rate))
    if len(samples) < size:
        return np.zeros((0, 12))
    window, used, classes = _classes(size, rate)
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    out = np.concatenate([np.square(np.abs(np.fft.rfft(frames[i : i + 256] * window)[:, used])) @ classes for i in range(0, len(frames), 256)])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0)


def filters() -> list[list[tuple[int, int, int, int, int]]]:
    """Sixteen filters as boxes (sign, first frame, frames, first class, classes): four kinds at four heights."""
    out = []
    for first, height in ((0, 6), (3, 6), (6, 6), (9, 6)):
        half, third = height // 2, height // 3
        out += [
            [(1, 0, SPAN, first, half), (-1, 0, SPAN, first + half, half)],
            [(1, 0, SPAN // 2, first, height), (-1, SPAN // 2, SPAN // 2, first, height)],
            [(1, 0, SPAN // 2, first, half), (-1, SPAN // 2, SPAN // 2, first, half), (-1, 0, SPAN // 2, first + half, half), (1, SPAN // 2, SPAN // 2, first + half, half)],
            [(2, 0, SPAN, first + third, third), (-1, 0, SPAN, first, third), (-1, 0, SPAN, first + 2 * third, third)],
        ]
    return out


FILTERS = filters()


def fingerprint(data: bytes | None) -> np.ndarray:
    frames = chroma(*decode(data))
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))  # classes twice: a filter may wrap around
    image[1:, 1:] = np.concatenate([frames, frames], axis=1).cumsum(axis=0).cumsum(axis=1)
    out = np.zeros(n, np.uint32)
    for boxes, step in zip(FILTERS, STEPS * 4, strict=True):
        value = np.zeros(n)
        for sign, start, wide, low, high in boxes:
            a, b = image[start : start + n], image[start + wide : start + wide + n]
            value += sign * (b[:, low + high] - a[:, low + high] - b[:, low] + a[:, low])
        value /= SPAN * boxes[0][4]
        level = (value > -step).astype(np.uint32) + (value > 0) + (value > step)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out


def fingerprints(df: DataFrame, media: Column, out: str = "fingerprint") -> DataFrame:
    """Add the integers as signed ones. media: a binary column of WAV files."""

    @F.arrow_udf("array<int>")
    def of(batch: pa.Array) -> pa.Array:
        found = [fingerprint(x.as_py()).view(np.int32) for x in batch]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return df.withColumn(out, of(media))


def _starts(fingerprint: np.ndarray) -> np.ndarray:
    """Places where a run of equal integers begins."""
    return np.flatnonzero(np.concatenate([[True], fingerprint[1:] != fingerprint[:-1]])) if len(fingerprint) else np.zeros(0, np.int64)


def error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and integers of the overlap, if place i of a stands at i - offset of b."""
    begin, end = max(0, offset), min(len(a), len(b) + offset)
    if end <= begin:
        return 0, 0
    return int(np.bitwise_count(a[begin:end] ^ b[begin - offset : end - offset]).sum()), end - begin


def matches(queries: list[np.ndarray], others: list[np.ndarray]):
    """(query, other, offset, error) of each pair that matches, at its best offset."""
    starts = [_starts(x) for x in others]
    values = np.concatenate([np.zeros(0, np.uint32), *(x[s] for x, s in zip(others, starts, strict=True))])
    owner, place = np.repeat(np.arange(len(others)), [len(s) for s in starts]), np.concatenate([np.zeros(0, np.int64), *starts])
    order = np.argsort(values, kind="stable")
    values, owner, place = values[order], owner[order], place[order]
    for q, query in enumerate(queries):
        own = _starts(query)
        low, high = np.searchsorted(values, query[own], "left"), np.searchsorted(values, query[own], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # a histogram of offsets for each recording
        shift = np.repeat(own, n) - place[at]
        reach = 1 << 32
        cells = np.unique(owner[at] * reach + shift + (reach >> 1))
        votes = np.stack([cells // reach, cells % reach - (reach >> 1)])
        found: dict[int, tuple[float, int]] = {}
        for other, offset in zip(*votes.tolist(), strict=True):
            bits, overlap = error(query, others[other], offset)
            if overlap >= min(MIN_OVERLAP, len(query), len(others[other])) and bits <= MAX_ERROR * 32 * overlap:
                found[other] = min(found.get(other, (2.0, 0)), (bits / (32 * overlap), offset))
        for other, (share, offset) in found.items():
            yield q, other, offset, share


def _compare(batches):
    for group in sorted_groups(batches, "tile"):
        asks = group["asks"].astype(bool)
        prints = [x.view(np.uint32) for x in group["fingerprint"]]
        queries, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        least, copies, class_ = group["least"], group["copies"], group["class"]
        n: dict[int, int] = {}
        best: dict[int, tuple[float, int, int]] = {}
        for q, other, offset, share in matches([prints[i] for i in queries], [prints[i] for i in others]):
            n[q] = n.get(q, 0) + int(copies[others[other]])
            if class_[others[other]] != class_[queries[q]]:  # copies are known already
                best[q] = min(best.get(q, (2.0, 0, 0)), (share, int(least[others[other]]), offset))
        if n:
            keys = [*n]
            lows = [best.get(q) for q in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(class_[queries[keys]]), pa.array([n[q] for q in keys], pa.int64()), pa.array([x and x[0] for x in lows], pa.float64()),
                    pa.array([x and x[1] for x in lows], pa.int64()), pa.array([x and x[2] for x in lows], pa.int64()),
                ],
                ["class", "matches", "error", "other", "offset"],
            )


def search(df: DataFrame, key: Column, asks: Column, fingerprint: str = "fingerprint") -> DataFrame:
    """For each row that asks: its columns but the fingerprint, ``n_matches`` (other rows that match), and of the
    best match ``match_key``, ``match_offset`` (integers by which it begins later in the row) and ``match_error``; ties
    go to the least key. If a row has equal ones, its best match is the least of them, or the greatest if it is the
    least itself. ``key``: a long that names a row.
    """
    keep = [c for c in df.columns if c != fingerprint]
    rows = df.select(*keep, F.col(fingerprint).alias("__print"), key.alias("__key"), F.coalesce(asks, F.lit(False)).alias("__asks"))
    known = F.size("__print") > 0
    hashes = [F.when(known, F.xxhash64("__print")).alias("__h1"), F.when(known, F.hash("__print")).alias("__h2")]
    rows = checkpoint(rows.select("*", *hashes))
    classes = rows.where(known).groupBy("__h1", "__h2").agg(F.first("__print").alias("fingerprint"), F.count("*").alias("copies"), F.min("__key").alias("least"), F.max("__key").alias("most"), F.max("__asks").alias("asks"))
    classes = checkpoint(classes).withColumn("class", F.monotonically_increasing_id())
    n, q = classes.agg(F.count("*"), F.count_if("asks")).head()
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-q // QUERY_BLOCK) or 1
    mixed = lambda m: F.pmod(F.xxhash64("class"), F.lit(m))
    columns = [F.col(c) for c in ("class", "fingerprint", "copies", "least")]
    others = classes.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_q"), *columns).select((mixed(blocks) * query_blocks + F.col("_q")).alias("tile"), F.lit(False).alias("asks"), *columns)
    wanted = classes.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), *columns).select((F.col("_b") * query_blocks + mixed(query_blocks)).alias("tile"), F.lit(True).alias("asks"), *columns)
    tiles = others.union(wanted).repartition("tile").sortWithinPartitions("tile")
    found = tiles.mapInArrow(_compare, "class long, matches long, error double, other long, offset long")
    best = F.min(F.when(F.col("other").isNotNull(), F.struct("error", "other", "offset")))
    found = found.groupBy("class").agg(F.sum("matches").alias("matches"), best.alias("best"))
    of = classes.where("asks").join(found, "class", "left").select("__h1", "__h2", *[F.col(c).alias(f"__{c}") for c in ("copies", "least", "most", "matches", "best")])
    out = rows.where("__asks").join(of, ["__h1", "__h2"], "left")
    copied = F.col("__copies") > 1
    copy = F.when(F.col("__least") < F.col("__key"), F.col("__least")).otherwise(F.col("__most"))
    return out.select(
        *keep,
        F.coalesce(F.greatest(F.col("__matches"), F.col("__copies")) - 1, F.lit(0)).cast("long").alias("n_matches"),
        F.when(copied, copy).otherwise(F.col("__best.other")).alias("match_key"),
        F.when(copied, 0).otherwise(F.col("__best.offset")).cast("long").alias("match_offset"),
        F.when(copied, 0.0).otherwise(F.col("__best.error")).alias("match_error"),
    )


#: A word's note lasts one hop; a rate of 2000 has a whole number of samples in a hop.
NOTE_RATE = 2000


@lru_cache
def _notes() -> np.ndarray:
    """24 x 24 chords of two tones from 110 Hz upwards, as samples of one hop."""
    t = np.arange(round(HOP * NOTE_RATE)) / NOTE_RATE
    tones = np.sin(2 * np.pi * 110 * 2 ** (np.arange(24)[:, None] / 12) * t)
    return (8000 * (tones[:, None] + tones[None])).astype("<i2")


def render(text: str | None) -> bytes:
    """A WAV file in which each word of a text is a chord: recordings for tables that have none."""
    words = (text or "").encode().split()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(NOTE_RATE)
        codes = np.array([crc32(w) for w in words], np.int64)
        f.writeframes(_notes()[codes % 24, codes // 24 % 24].tobytes())
    return out.getvalue()


def rendered(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([render(x.as_py()) for x in batch], pa.binary())

    return of(text)

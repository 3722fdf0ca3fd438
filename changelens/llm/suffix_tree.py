"""Language-model scoring: a probabilistic suffix tree over words.

``learn`` counts a corpus and builds the core of the tree, ``score`` gives each text's log10
probability under the tree, beside that of the smoothed word counts alone.

Tokens are the words of the lower-cased text (A-Z, ASCII white space) and one end.
The root is the distribution (c+1)/(N+V+1) over the V known words and one place for
all others. A context is a run of up to ``DEPTH`` tokens before the next one, none
of them beyond the text's begin (which the end token stands for). Its next symbols are those
with ``MIN_NEXT`` of its occurrences. It becomes a state if its next-symbol
distribution diverges from that of its longest suffix that is a state: by
``MIN_NATS`` a token, and ``MIN_EVIDENCE`` in all. A state's symbols keep their share
less a discount, and what is left is spread as its suffix spreads it, so that all
distributions sum to one. A token is scored in the longest suffix of the text
before it that is a state.

The tree has a core and a rim. The core are the contexts with a share of ``MIN_CONTEXT`` of all
tokens: at most 1/MIN_CONTEXT of each length, which every task holds. The rim are the contexts one word
longer than the core's (or of one word, if that isn't in the core) that occur twice or more: with the corpus their
number grows without bound, what counts for them is the evidence alone. They are never gathered: each (context, next symbol)
of a text goes to its context's bucket, as sorted and packed numbers; there the contexts are tested by what the training
texts have, and all texts' occurrences are scored in them. No context of the rim has more than a share of MIN_CONTEXT of
all tokens, so buckets of some ``BUCKET`` occurrences are even.

Words are counted over the whole training corpus in Spark. Next symbols are words with ``MIN_SYMBOL`` of all tokens (at most
1/MIN_SYMBOL), others follow a state as its suffix has it; their counts never reach the driver or a broadcast, but
meet their occurrences in a join. Any word may stand in a context of the rim, where 40 bits of its XXH64 name it beside the core's context. Contexts of the core are
counted one length after another, each from those of the length before; a symbol too rare to matter for a context isn't counted
with it, which changes no result.

Defined results: null counts as an empty text, which is one end token; without any
training text N and V are 0; repeated rows count and are scored each; missing ids are
in fold 0; keys may be of any type.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import checkpoint, sorted_groups

DEPTH = 3
MIN_SYMBOL, MIN_CONTEXT, MIN_NEXT = 1e-6, 5e-5, 0.01
MIN_NATS, MIN_EVIDENCE, DISCOUNT = 0.02, 10.0, 0.5
#: Distinct keys that a task holds before it hands them on.
HELD = 500_000
#: Occurrences that a bucket of the rim is meant to hold, and those that a task packs at a time.
BUCKET, PACKED = 1 << 21, 1 << 20
#: Bits of a word's hash in a context of the rim; what stands above is the core's context after it.
HASH = 40
#: Stands for a next word that is no symbol; an odd factor, and its inverse modulo 2^64, by which contexts are mixed.
RARE, MIX = np.int64((1 << 31) - 1), 0x9E3779B97F4A7C15
UNMIX = np.uint64(pow(MIX, -1, 1 << 64))
END = b""


@dataclass
class Level:
    """Contexts of one length: sorted keys (index of the shorter context * symbols + last symbol), and states' numbers."""

    keys: np.ndarray
    counts: np.ndarray
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of what a state leaves to its suffix, relative to the suffix's own
    next_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # context * symbols + next symbol
    next_logs: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Model:
    words: list[bytes]  # by count, the most frequent first
    word_counts: np.ndarray
    total: int
    distinct: int
    levels: list[Level]
    key: str = ""
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of the words

    @property
    def logs(self) -> np.ndarray:
        return np.log10((self.word_counts + 1) / (self.total + self.distinct + 1))


_numbers: dict[str, dict[bytes, int]] = {}


def _number(model: Model) -> dict[bytes, int]:
    if model.key not in _numbers:
        _numbers.clear()
        _numbers[model.key] = {w: i for i, w in enumerate(model.words)}
    return _numbers[model.key]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted keys among the sorted ones, -1 for none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _symbols(batch: pa.Array, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Symbols of an end and then each text's words and its end (-1: a rare word); number of tokens of each text; the words."""
    flat, lengths = [END], np.zeros(len(batch), np.int64)
    for i, text in enumerate(batch):
        found = tokens(text.as_py())
        flat.extend(found)
        flat.append(END)
        lengths[i] = len(found) + 1
    return np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat)), lengths, flat


def _contexts(symbols: np.ndarray, levels: list[Level], end: int, n_symbols: int) -> Iterator[np.ndarray]:
    """By level, the index of the context that ends at each place, -1 for none."""
    before = None
    for i, level in enumerate(levels):
        if i == 0:
            at = np.where(symbols < len(level.keys), symbols, -1)  # the most frequent words come first
            at[symbols == end] = end if end < len(level.keys) else -1
        else:
            at = np.full(len(symbols), -1, np.int64)
            ok = np.flatnonzero((before[:-1] >= 0) & (symbols[1:] >= 0) & (symbols[1:] != end)) + 1
            at[ok] = _find(level.keys, before[ok - 1] * n_symbols + symbols[ok])
        yield at
        before = at


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of a text column: summed by task, then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                held[END] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _next_counts(texts: DataFrame, model: Model, least: np.ndarray, spread) -> DataFrame:
    """(key, n): how often each next symbol follows each context of the last level, if at least ``least`` by context."""
    n_symbols = len(model.words)
    # a symbol can't follow more often than it occurs: by context, the number of symbols that occur often enough
    wide = np.searchsorted(-model.word_counts, -least, "right")
    sent = spread((model, least, wide))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, wide = sent.value
        number, keys, counts, held = _number(model), [], [], 0
        for batch in batches:
            symbols, _, _ = _symbols(batch.column(0), number)
            *_, at = _contexts(symbols, model.levels, number[END], n_symbols)
            at, after = at[:-1], symbols[1:]
            ok = (at >= 0) & (after >= 0)
            at, after = at[ok], after[ok]
            ok = after < wide[at]
            found, n = np.unique(at[ok] * n_symbols + after[ok], return_counts=True)
            keys.append(found)
            counts.append(n)
            held += len(found)
            if held > 4 * HELD:
                found, n = _merged(keys, counts)
                keys, counts, held = [found], [n], len(found)
                if held > 2 * HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])
                    keys, counts, held = [], [], 0
        if keys:
            found, n = _merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, least, _ = sent.value
        for batch in batches:
            yield batch.filter(pa.array(batch.column(1).to_numpy() >= least[batch.column(0).to_numpy() // n_symbols]))

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(often, "key long, n long")


def learn(texts: DataFrame, counts: DataFrame) -> Model:
    """The core. texts: one column, the training texts; counts: their ``word_counts``, written once."""
    spread = texts.sparkSession.sparkContext.broadcast
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    rows = counts.where((F.col("n") >= MIN_SYMBOL * total) | (F.col("word") == END)).orderBy(F.desc("n"), "word").toArrow()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy().astype(np.int64)
    if END not in words:
        words, n = [*words, END], np.append(n, 0)
    model = Model(words, n, total, distinct, [], uuid.uuid4().hex, np.array([xxh64_intdigest(w) for w in words], np.uint64))
    n_symbols, end = len(words), words.index(END)
    first = int((n >= MIN_CONTEXT * total).sum()) if total else 0
    runs = [[(i,) for i in range(first)]]  # symbols of each context, by level
    level = Level(np.arange(first), n[:first])
    while len(level.keys) and len(model.levels) < DEPTH:
        model.levels.append(level)
        least = np.maximum(1, np.minimum(MIN_NEXT * level.counts, MIN_CONTEXT * total))
        found = _next_counts(texts, model, least, spread).orderBy("key").toArrow()
        keys, after = found.column("key").to_numpy(), found.column("n").to_numpy()
        _keep_diverging(model, runs, keys, after)
        deeper = (after >= MIN_CONTEXT * total) & (keys % n_symbols != end)
        level = Level(keys[deeper], after[deeper])
        runs.append([(*runs[-1][k // n_symbols], k % n_symbols) for k in level.keys.tolist()])
    return model


def _keep_diverging(model: Model, runs: list[list[tuple[int, ...]]], keys: np.ndarray, counts: np.ndarray) -> None:
    """Make states of the last level's contexts that pass the divergence test."""
    n_symbols, level, logs = len(model.words), model.levels[-1], model.logs
    known = [{run: i for i, run in enumerate(r)} for r in runs[:-1]]
    level.state, level.back = np.zeros(len(level.keys), bool), np.zeros(len(level.keys))
    next_keys, next_logs = [], []
    tables = [dict(zip(x.next_keys.tolist(), x.next_logs.tolist(), strict=True)) for x in model.levels[:-1]]

    def shorter(run: tuple[int, ...], symbol: int) -> float:
        """log10 probability of a symbol in the longest proper suffix that is a state."""
        log = 0.0
        for size in range(len(run) - 1, 0, -1):
            at = known[size - 1].get(run[len(run) - size :])
            if at is not None and model.levels[size - 1].state[at]:
                if (own := tables[size - 1].get(at * n_symbols + symbol)) is not None:
                    return log + own
                log += float(model.levels[size - 1].back[at])
        return log + float(logs[symbol])

    bounds = np.searchsorted(keys, np.arange(len(level.keys) + 1) * n_symbols)
    for at, (run, n, start, stop) in enumerate(zip(runs[-1], level.counts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        symbols, share = keys[start:stop] % n_symbols, (counts[start:stop] - DISCOUNT) / max(1, n)
        often = counts[start:stop] >= max(1, MIN_NEXT * n)
        symbols, share = symbols[often], share[often]
        if not len(symbols):
            continue
        suffix = np.array([10 ** shorter(run, s) for s in symbols.tolist()])
        rest, suffix_rest = max(1e-9, 1 - share.sum()), max(1e-9, 1 - suffix.sum())
        nats = float((share * np.log(share / suffix)).sum() + rest * np.log(rest / suffix_rest))
        if nats >= MIN_NATS and nats * n >= MIN_EVIDENCE:
            level.state[at], level.back[at] = True, np.log10(rest / suffix_rest)
            next_keys.append(at * n_symbols + symbols)
            next_logs.append(np.log10(share))
    if next_keys:
        level.next_keys, level.next_logs = np.concatenate(next_keys), np.concatenate(next_logs)


def _log(model: Model, ats: list[np.ndarray], after: np.ndarray) -> np.ndarray:
    """log10 probability of each next symbol in the longest context (by level, its index) that is a state; a rare word's lacks its share of the root."""
    n_symbols = len(model.words)
    out, open_ = np.zeros(len(after)), np.ones(len(after), bool)
    for level, at in reversed(list(zip(model.levels, ats, strict=False))):
        places = np.flatnonzero(open_ & (at >= 0))
        places = places[level.state[at[places]]]
        found = np.where(after[places] >= 0, _find(level.next_keys, at[places] * n_symbols + after[places]), -1)
        hit = found >= 0
        out[places[hit]] += level.next_logs[found[hit]]
        out[places[~hit]] += level.back[at[places[~hit]]]
        open_[places[hit]] = False
    places = np.flatnonzero(open_ & (after >= 0))
    out[places] += model.logs[after[places]]
    return out


def _rim(symbols: np.ndarray, flat: list[bytes], ats: list[np.ndarray], model: Model, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a word follows whose context in the rim is known, and these contexts, mixed."""
    hashes = model.hashes[symbols]
    rare = np.flatnonzero(symbols < 0)
    hashes[rare] = np.fromiter((xxh64_intdigest(flat[i]) for i in rare.tolist()), np.uint64, len(rare))
    hashes &= np.uint64((1 << HASH) - 1)
    code, first = np.zeros(len(symbols), np.int64), 1  # of the core's context: 0 is the root
    unit, known = np.zeros(len(symbols), np.uint64), np.zeros(len(symbols), bool)
    open_ = np.ones(len(symbols), bool)
    open_[-1] = False  # nothing follows
    for size in range(DEPTH):
        at = ats[size] if size < len(ats) else np.full(len(symbols), -1, np.int64)
        here = np.flatnonzero(open_ & (at < 0))
        here = here[here >= size]
        unit[here] = code[here].astype(np.uint64) << np.uint64(HASH) | hashes[here - size]
        known[here] = True
        open_ &= at >= 0
        code = first + at
        first += len(model.levels[size].keys) if size < len(model.levels) else 0
        ended = np.zeros(len(symbols), bool)
        ended[size:] = symbols[: len(symbols) - size] == end
        open_ &= ~ended  # a longer context would reach beyond the begin
    places = np.flatnonzero(known)
    return places, unit[places] * np.uint64(MIX)


def _core(units: np.ndarray, model: Model) -> list[np.ndarray]:
    """By level, the core's context after the first word of each context of the rim."""
    code = ((units * UNMIX) >> np.uint64(HASH)).astype(np.int64) - 1
    out = [np.full(len(units), -1, np.int64) for _ in model.levels]
    for size, level in enumerate(model.levels[: DEPTH - 1]):
        here = np.flatnonzero((code >= 0) & (code < len(level.keys)))
        at = code[here]
        for shorter in range(size, -1, -1):  # the context and its suffixes
            out[shorter][here] = at
            if shorter:
                at = _suffix(model, shorter, at)
        code = np.where(code >= len(level.keys), code - len(level.keys), -1)
    return out


def _suffix(model: Model, size: int, at: np.ndarray) -> np.ndarray:
    """Index, in the level below, of what follows the first word of each context of a level; the core holds it, as it is as frequent at least."""
    n_symbols, keys = len(model.words), model.levels[size].keys[at]
    if size == 1:
        return keys % n_symbols
    return _find(model.levels[size - 1].keys, _suffix(model, size - 1, keys // n_symbols) * n_symbols + keys % n_symbols)


def _bucket(units: np.ndarray, buckets: int) -> np.ndarray:
    return ((units >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values[:, None].view(np.uint8).T).tobytes())


def _unpack(packed: list[bytes], kind: type) -> np.ndarray:
    planes = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1) for x in packed)
    return np.concatenate([np.zeros(0, kind), *(np.ascontiguousarray(x.T).view(kind).ravel() for x in planes)])


def _dealt(units: list[np.ndarray], others: list[list[np.ndarray]], buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """By bucket, contexts (sorted, as differences) and what belongs to them, packed."""
    unit = np.concatenate([np.zeros(0, np.uint64), *units])
    if not len(unit):
        return
    order = np.argsort(unit)
    unit, rest = unit[order], [np.concatenate(x)[order] for x in others]
    which = _bucket(unit, buckets)
    cuts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
    for start, stop in zip(cuts, [*cuts[1:], len(unit)], strict=True):
        yield int(which[start]), [_pack(np.diff(unit[start:stop], prepend=np.uint64(0))), *(_pack(x[start:stop]) for x in rest)]


def _units(packed: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_unpack([x], np.uint64), dtype=np.uint64) for x in packed)])


@dataclass
class Rim:
    """The states of a bucket: sorted contexts, and keys of (place of the context, next symbol); logs are relative to the core's."""

    units: np.ndarray
    back: np.ndarray
    keys: np.ndarray
    logs: np.ndarray

    def add(self, unit: np.ndarray, after: np.ndarray) -> np.ndarray:
        """What the states add to the core's log of each occurrence."""
        at = _find(self.units, unit)
        known = np.flatnonzero(at >= 0)
        place = _find(self.keys, at[known] << 31 | after[known])
        out = np.zeros(len(unit))
        out[known] = np.where(place >= 0, self.logs[place] if len(self.logs) else 0, self.back[at[known]])
        return out


def _rim_of(unit: np.ndarray, after: np.ndarray, model: Model, least_share: float) -> Rim:
    """The states among the contexts of a bucket's training occurrences."""
    found, of, n = np.unique(unit, return_inverse=True, return_counts=True)
    often = n[of] > 1
    pairs, c = np.unique(of[often] << 31 | after[often], return_counts=True)
    of, after = pairs >> 31, pairs & RARE
    ok = (after != RARE) & (c >= least_share * n[of])
    of, after, c = of[ok], after[ok], c[ok]
    share, log = (c - DISCOUNT) / n[of], _log(model, _core(found[of], model), after)
    total = lambda x: np.bincount(of, x, len(found))
    rest, suffix_rest = np.maximum(1e-9, 1 - total(share)), np.maximum(1e-9, 1 - total(10**log))
    nats = total(share * (np.log(share) - log * np.log(10))) + rest * np.log(rest / suffix_rest)
    state = (nats >= MIN_NATS) & (nats * n >= MIN_EVIDENCE) & (total(np.ones(len(of))) > 0)
    kept = state[of]
    return Rim(found[state], np.log10(rest / suffix_rest)[state], (np.cumsum(state) - 1)[of[kept]] << 31 | after[kept], (np.log10(share) - log)[kept])


def _row(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text)).alias("row")


def score(df: DataFrame, model: Model, counts: DataFrame, trains: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row. trains: whether a row is a training text; counts: the
    words' counts that the model was learned with.
    """
    sent, packed_at, least_share = df.sparkSession.sparkContext.broadcast(model), PACKED, MIN_NEXT
    buckets, floor = -(-model.total // BUCKET) or 1, model.total + model.distinct + 1
    parts = -(-buckets // 8)
    key_type = df.schema[key].dataType.simpleString()
    kind, kept = to_arrow_type(df.schema[key].dataType), ["uid", "key", "row", "n_tokens", "known", "base", "score"]
    fields = f"key {key_type}, row long, n_tokens long, known long, base double, score double"
    typed = f"bucket long, uid long, {fields}, units binary, nexts binary, uids binary"
    names = ["bucket", *kept, "units", "nexts", "uids"]

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and packed occurrences of contexts of the rim."""
        model = sent.value
        number, logs = _number(model), model.logs
        uid = TaskContext.get().partitionId() << 40
        held: list[list[np.ndarray]] = [[], [], []]

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, packed in _dealt(held[0], held[1:], buckets):
                blank = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *blank, *(pa.array([x], pa.binary()) for x in packed)], names)
            for x in held:
                x.clear()

        for batch in batches:
            symbols, lengths, flat = _symbols(batch.column(2), number)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            common = symbols[1:] >= 0
            base = np.where(common, logs[symbols[1:]], 0)
            known = common & (model.word_counts[symbols[1:]] > 0)
            ats = list(_contexts(symbols, model.levels, number[END], len(model.words)))
            sums = [np.bincount(owner, x, len(lengths)) for x in (known, base, _log(model, [at[:-1] for at in ats], symbols[1:]))]
            uids = uid + np.arange(len(lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids % buckets), pa.array(uids), batch.column(0), batch.column(1), pa.array(lengths), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *(pa.nulls(len(lengths), pa.binary()) for _ in range(3))],
                names,
            )
            places, unit = _rim(symbols, flat, ats, model, number[END])
            after = symbols[places + 1]
            learns = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)[owner[places]]
            for x, values in zip(held, (unit, np.where(after >= 0, after, RARE).astype(np.int32), (uid + owner[places]) << 1 | learns), strict=True):
                x.append(values)
            uid += len(lengths)
            if sum(map(len, held[0])) > packed_at:
                yield from out()
        yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts' rows as they are, and what the rim adds to texts, packed by part."""
        model, texts = sent.value, []
        found: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column("units").is_null()
                texts.append(batch.filter(text).select(kept))
                yield batch.filter(pc.invert(text)).select(["bucket", "units", "nexts", "uids"])

        def whole() -> Iterator[pa.RecordBatch]:
            while texts:
                batch = texts.pop()
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() % parts), *batch.columns, *(pa.nulls(batch.num_rows, pa.binary()) for _ in range(2))], ["part", *kept, "uids", "rims"])

        def out() -> Iterator[pa.RecordBatch]:
            uid, value = np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0), *values])
            which = uid % parts
            order = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.diff(which[order], prepend=-1)).tolist()
            for start, stop in zip(cuts, [*cuts[1:], len(order)], strict=False):
                at = order[start:stop]
                blank = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(which[at[:1]]), *blank, *(pa.array([_pack(x[at])], pa.binary()) for x in (uid, value))], ["part", *kept, "uids", "rims"])
            found.clear()
            values.clear()

        for group in sorted_groups(packed(), "bucket"):
            yield from whole()
            unit, after, uid = _units(group["units"]), _unpack(group["nexts"], np.int32), _unpack(group["uids"], np.int64)
            learns = (uid & 1).astype(bool)
            value = _rim_of(unit[learns], after[learns], model, least_share).add(unit, after)
            own, which = np.unique(uid[value != 0] >> 1, return_inverse=True)
            found.append(own)
            values.append(np.bincount(which, value[value != 0], len(own)).astype(np.float64))
            if sum(map(len, found)) > packed_at:
                yield from out()
        yield from whole()
        yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's row with all that the rim adds to it; in a part, packed rows come first."""
        part, held, table = None, [], None
        for batch in batches:
            parts_, text = batch.column("part").to_numpy(), batch.column("uids").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(parts_) | np.diff(text)) + 1).tolist(), len(parts_)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if parts_[start] != part:
                    part, held, table = parts_[start], [], None
                rows = batch.slice(start, stop - start)
                if not text[start]:
                    held += [(_unpack([u.as_py()], np.int64), _unpack([v.as_py()], np.float64)) for u, v in zip(rows.column("uids"), rows.column("rims"), strict=True)]
                    continue
                if table is None:
                    found, which = np.unique(np.concatenate([np.zeros(0, np.int64), *(u for u, _ in held)]), return_inverse=True)
                    table = found, np.bincount(which, np.concatenate([np.zeros(0), *(v for _, v in held)]), len(found))
                    held = []
                at = _find(table[0], rows.column("uid").to_numpy())
                sums = np.where(at >= 0, table[1][at] if len(table[1]) else 0.0, 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*rows.select(kept[1:]).columns, pa.array(sums)], [*kept[1:], "rim"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _number(sent.value)
        for batch in batches:
            rows, words, n = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(w for w in tokens(text.as_py()) if w not in number)
                rows.extend(repeat(row, len(found)))
                words.extend(found.keys())
                n.extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["row", "word", "m"])

    dealt = df.select(F.col(key).alias("key"), _row(key, text), text, F.coalesce(trains, F.lit(False)).alias("trains")).mapInArrow(frequent, typed)
    met = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, f"part long, uid long, {fields}, uids binary, rims binary")
    often = checkpoint(met.repartition(parts, "part").sortWithinPartitions("part", F.col("uids").isNull()).mapInArrow(gather, f"{fields}, rim double"))
    seldom = df.select(_row(key, text), text).mapInArrow(rare, "row long, word binary, m long").join(counts.where(F.col("n") < MIN_SYMBOL * model.total), "word", "left")
    each = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(floor)))
    seldom = seldom.groupBy("row").agg(F.sum(F.col("m") * each).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("rare_known"))
    copies = often.groupBy("row").agg(F.count("*").alias("copies"))  # equal rows share a number, and have added up
    seldom = seldom.join(copies, "row").select(F.col("row").alias("at"), (F.col("rare") / F.col("copies")).alias("rare"), F.expr("rare_known div copies").alias("rare_known"))
    out = often.join(seldom, often.row == seldom.at, "left")
    rest, rest_known = F.coalesce("rare", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return out.select(
        F.col("key").alias(key), "n_tokens", (F.col("known") + rest_known).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"), (F.col("score") + rest + F.col("rim")).alias("score"),
    )

"""Ranked lexical search of a set of items over all documents, by sorting what they accumulate.

Method: documents are read once into postings of the items' terms (term, frequency), which are written to the shared
folder, as the weights need counts over all documents. Then each batch of postings is joined
with the items that hold a term: arrays of (item, document, impact) are put end to end, their packed
keys are sorted by radix, 16 bits a pass, and each run of a key is summed by ``reduceat``. A heap of the best for
each item runs through a task; the tasks' heaps are range-partitioned by item and selected by heaps again.
A task holds its items' heaps and one batch.

Terms are maximal runs of ASCII letters, digits and any character beyond ASCII, only A-Z lower-cased.
The arithmetic is that of ``weight`` and ``impacts``: whole numbers throughout, with one logarithm.

Defined results: a null text, one without a term, or one with none of an item's terms has no score for it; an item with none
has no rows. Documents with equal texts have equal scores and stand by ascending id; each row of either table
counts by itself, also with ids that occur before. Document ids are whole numbers; a null one comes after all others of its score.
The items' other columns and the documents' other columns don't matter. Sums hold as long as 50 * (terms of a document) * (documents) is below 2^63.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import checkpoint, offsets, take_ranges, written

#: (item, term) pairs that are searched for at a time; more items go through the documents in several blocks.
BLOCK_PAIRS = 2_000_000
#: A null document id in sorting; after all others.
LAST = np.iinfo(np.int64).max
#: What separates terms, as a translation of bytes; A-Z become a-z.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

POSTINGS = "doc long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score: weights and frequencies of postings, n: terms of their documents."""
    m = 50 + 50 * n * n_docs // n_terms
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """A stable order of keys of some bits, 16 of them a pass."""
    order = np.arange(len(keys))
    for low in range(0, bits, 16):
        digit = (keys[order] >> low & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


class Heaps:
    """The best ``k`` of each item so far: highest score, then least document."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.floor = np.zeros(n_items, np.int64)

    def push(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        chance = np.flatnonzero((scores > 0) & (scores >= self.floor[items]))
        for item, doc, score in zip(items[chance].tolist(), docs[chance].tolist(), scores[chance].tolist(), strict=True):
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))
            else:
                continue
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]

    def best(self, item: int) -> list[tuple[int, int]]:
        return [(score, -doc) for score, doc in sorted(self.heaps[item], reverse=True)]


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc, n, terms, tfs) of each text with a term: its length and the items' terms that it holds. docs: (doc, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        for batch in batches:
            ids, ns, sizes, terms, tfs = [], [], [], [], []
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    known = np.fromiter((i for i in map(place.get, found) if i is not None), np.int32)
                    distinct, counts = np.unique(known, return_counts=True)
                    ids.append(doc)
                    ns.append(len(found))
                    sizes.append(len(distinct))
                    terms.append(distinct)
                    tfs.append(counts)
            ends = pa.array(offsets(np.array(sizes, np.int64)).astype(np.int32))
            flat = [pa.array(np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32)) for x in (terms, tfs)]
            lists = [pa.ListArray.from_arrays(ends, x) for x in flat]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    return docs.mapInArrow(read, POSTINGS)


def _accumulate(postings: DataFrame, held, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score): each task's best ``k`` documents of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, sizes, owners, n_items = held.value
        heaps = Heaps(n_items, k)
        for batch in batches:
            ids = batch["doc"].fill_null(LAST).to_numpy(zero_copy_only=False)
            counts = batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(ids)), counts)
            terms = batch["terms"].flatten().to_numpy().astype(np.int64)
            tf = batch["tfs"].flatten().to_numpy().astype(np.int64)
            gain = impacts(weights[terms], tf, batch["n"].to_numpy()[row], n_docs, n_terms)
            ends = offsets(sizes[terms])
            for low, high in _pieces(ends, offsets(counts)):  # whole documents, a bounded number of triples at a time
                some = slice(low, high)
                items = take_ranges(owners, starts[terms[some]], sizes[terms[some]])
                if not len(items):
                    continue
                keys = items.astype(np.int64) << 32 | np.repeat(row[some], sizes[terms[some]])
                added = np.repeat(gain[some], sizes[terms[some]])
                order = radix_order(keys & 0xFFFFFFFF, max(16, len(ids).bit_length()))
                order = order[radix_order(keys[order] >> 32, max(16, n_items.bit_length()))]
                keys, added = keys[order], added[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                heaps.push(keys[first] >> 32, ids[keys[first] & 0xFFFFFFFF], np.add.reduceat(added, first))
        yield from _rows(heaps)

    return postings.mapInArrow(scan, FOUND)


#: Triples that are sorted at a time, but for a single document's.
BLOCK_TRIPLES = 4_000_000


def _pieces(triples: np.ndarray, documents: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of postings, cut between documents. triples: running sums by posting, documents: by document, of postings."""
    at = 0
    while at < len(documents) - 1:
        full = np.searchsorted(triples[documents], triples[documents[at]] + BLOCK_TRIPLES, "right") - 1
        to = max(at + 1, int(full))
        yield int(documents[at]), int(documents[to])
        at = to


def _rows(heaps: Heaps) -> Iterator[pa.RecordBatch]:
    found = [(item, doc, score) for item in range(len(heaps.heaps)) for score, doc in heaps.best(item)]
    items, docs, scores = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    yield pa.RecordBatch.from_arrays([pa.array(items.astype(np.int32)), pa.array(docs), pa.array(scores)], ["item", "doc", "score"])


def _select(found: DataFrame, k: int, n_items: int) -> DataFrame:
    """(item, rank, doc, score) of the best over all tasks."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n_items, k)
        for batch in batches:
            heaps.push(*(batch[c].to_numpy() for c in ("item", "doc", "score")))
        out = [(item, rank, None if doc == LAST else doc, score) for item in range(n_items) for rank, (score, doc) in enumerate(heaps.best(item), 1)]
        yield pa.RecordBatch.from_pylist([dict(zip(("item", "rank", "doc", "score"), r, strict=True)) for r in out], pa.schema([("item", pa.int32()), ("rank", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())]))

    return checkpoint(found).repartitionByRange("item").mapInArrow(best, "item int, rank int, doc long, score long")


def _search_block(docs: DataFrame, items: Sequence[Row], k: int) -> DataFrame:
    spark = docs.sparkSession
    distinct = [set(terms_of(r.text)) for r in items]
    place = {t: i for i, t in enumerate(sorted(set().union(*distinct)))}
    pairs = sorted((place[t], i) for i, terms in enumerate(distinct) for t in terms)
    postings = written(_postings(docs, spark.sparkContext.broadcast(place)), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    frequency = {r.term: r.df for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the block
    weights = np.array([weight(n_docs, frequency.get(i, 0)) for i in range(len(place))], np.int64)
    sizes = np.bincount([t for t, _ in pairs], minlength=len(place)).astype(np.int64)
    owners = np.array([i for _, i in pairs], np.int32)
    held = spark.sparkContext.broadcast((weights, offsets(sizes)[:-1], sizes, owners, len(items)))
    return _select(_accumulate(postings, held, n_docs, n_terms, k), k, len(items))


def search(docs: DataFrame, items: DataFrame, k: int, doc: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The items' columns with (rank, doc, score) of each item's ``k`` best documents.

    The items are read in blocks of at most ``BLOCK_PAIRS`` words, whatever their number; only a block is ever in memory.
    """
    rows = checkpoint(items.select(F.struct(*items.columns).alias("row"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).withColumn("id", F.monotonically_increasing_id()))
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", "[^0-9A-Za-z]+"))), F.lit(0))).head()[0]
    blocks = 1 + words // BLOCK_PAIRS
    body = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    out = None
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        held = block.select("id", "text").orderBy("id").collect()
        numbers = docs.sparkSession.createDataFrame([(i, r.id) for i, r in enumerate(held)], "item int, id long")
        found = _search_block(body, held, k).join(F.broadcast(numbers), "item").join(block.select("id", "row"), "id").select("row.*", "rank", F.col("doc"), "score")
        out = found if out is None else out.unionByName(found)
    return out

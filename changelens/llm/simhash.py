"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles.

``fingerprints`` adds a fingerprint of a text's word shingles, ``groups`` finds
the components of fingerprints at ``RADIUS`` or fewer differing bits, and
``keep_one`` leaves one document of each. ``keep_one_similar`` does so for documents
whose sets of shingles have a given Jaccard similarity: 64 bits tell copies with a
changed word or two, similarities of 0.8 need longer sketches, and the sets themselves where these can't tell.

Method: equal fingerprints are one. A tile holds the fingerprints with the same
population counts of their four 16-bit quarters (at most 17^4 tiles); two tiles
whose counts differ by more than the radius in sum can't hold a link, so a
fingerprint goes only to its own tile and to the 40 at most within the radius.
There blocks of bounded size are compared by exclusive-or and bit counts in
numpy, all against all, and leave a spanning forest of the links they found: no
link between components is lost, and a group of near copies never turns into
all its pairs.

Defined results: null and empty texts have fingerprint zero, which links like any
other; repeated rows are copies of each other; a document without an id counts as
one with an id above all others, and its component is null if nothing else is in
it. Ids are whole numbers below 2^62; name rows of other kinds by numbers first. Of rows that only differ in other columns
the one with the least hash of all columns stays. Columns of the input stay, but for one with the name of an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpoint, components, forest, sorted_groups, take_ranges

RADIUS = 2
#: Ids that stand for missing ones begin here.
NO_ID = 1 << 62
#: Fingerprints of a block, and rows of a block that are compared at a time.
BLOCK, STRIP = 4096, 64
#: Hashes whose bits are counted in one lane of a byte each.
LANE = 255
ONES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits that are set in over half of the shingles' hashes (XXH64, seed 42)."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    n = len(found) - words + 1
    starts = (ends - lengths)[:n].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    return int(_majority(hashes[None])[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes: the bits that are set in over half of them."""
    counts, n = np.zeros((len(hashes), 8, 8), np.int64), hashes.shape[1]  # by byte, by bit of it
    for i in range(0, n, LANE * 256):
        part = hashes[:, i : i + LANE * 256]
        padded = np.zeros((len(part), -(-part.shape[1] // LANE) * LANE), np.uint64)
        padded[:, : part.shape[1]] = part
        for bit in range(8):
            lanes = ((padded >> np.uint64(bit)) & ONES).reshape(len(part), -1, LANE).sum(axis=2)
            counts[:, :, bit] += lanes.view(np.uint8).reshape(len(part), -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits((2 * counts > n).reshape(len(hashes), 64), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.fromiter((fingerprint(t.as_py(), words) for t in batch), np.uint64, len(batch)).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


SHIFTS = {r: np.array([x for x in product(range(-r, r + 1), repeat=4) if sum(map(abs, x)) <= r]) for r in range(4)}
PLACES = np.array([17**3, 17**2, 17, 1])
TILES = 17**4


def _counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the quarters, a row for each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _tile_sizes(prints: DataFrame) -> np.ndarray:
    """How many fingerprints each tile holds: TILES counts, whatever the data."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(TILES, np.int64)
        for batch in batches:
            sizes += np.bincount(_counts(batch.column(0).to_numpy()) @ PLACES, minlength=TILES)
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[at])], ["tile", "n"])

    out = np.zeros(TILES, np.int64)
    for row in prints.select("fingerprint").mapInArrow(tile, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).collect():
        out[row.tile] = row.n
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (column ``fingerprint``); radius up to 3."""
    shifts = SHIFTS[radius]
    own = _tile_sizes(prints)
    padded = np.pad(own.reshape(17, 17, 17, 17), radius)
    near = sum(padded[tuple(slice(radius + d, radius + d + 17) for d in shift)] for shift in shifts).ravel()
    near[own == 0] = 0  # nothing to compare with
    tables = prints.sparkSession.sparkContext.broadcast((-(-own // BLOCK), -(-near // BLOCK)))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, guests = tables.value
        for batch in batches:
            prints = batch.column(0).to_numpy()
            mixed = (prints.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            counts = _counts(prints)
            for home, steps in ((True, np.zeros((1, 4), np.int64)), (False, shifts)):
                at = counts[None] + steps[:, None]
                ok = ((at >= 0) & (at <= 16)).all(axis=2)
                tile = (at @ PLACES)[ok]
                row = np.broadcast_to(np.arange(len(prints)), ok.shape)[ok]
                mine, others = (blocks[tile], guests[tile]) if home else (guests[tile], blocks[tile])
                each = np.where(mine > 0, others, 0)  # a row meets every block of the other kind
                first = np.repeat(np.cumsum(each) - each, each)
                tile, row, mine = np.repeat(tile, each), np.repeat(row, each), np.repeat(mine, each)
                other, split = np.arange(len(tile)) - first, mixed[row] % np.maximum(mine, 1)
                pair = split * guests[tile] + other if home else other * guests[tile] + split
                yield pa.RecordBatch.from_arrays([pa.array(tile << 45 | pair), pa.array(np.full(len(tile), home)), pa.array(prints[row])], ["pair", "home", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "pair"):
            prints, home = group["fingerprint"].view(np.uint64), group["home"].astype(bool)
            own, others = np.unique(prints[home]), np.unique(prints[~home])
            if not len(own) or not len(others):
                continue
            every = np.unique(np.concatenate([own, others]))
            at_own, at_others = np.searchsorted(every, own), np.searchsorted(every, others)
            label = np.arange(len(every))
            for i in range(0, len(own), STRIP):
                x, y = np.nonzero(np.bitwise_count(own[i : i + STRIP, None] ^ others) <= radius)
                a, b = at_own[i + x], at_others[y]
                apart = label[a] != label[b]
                if apart.any():
                    label = forest(np.concatenate([a[apart], np.arange(len(every))]), np.concatenate([b[apart], label]), len(every))
            moved = np.flatnonzero(label != np.arange(len(every)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(every[moved].view(np.int64)), pa.array(every[label[moved]].view(np.int64))], ["a", "b"])

    out = prints.select("fingerprint").mapInArrow(tiles, "pair long, home boolean, fingerprint long")
    return out.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, root) of every distinct fingerprint; ``prints`` (read several times) has them in any number of rows."""
    distinct = prints.select("fingerprint").distinct()
    found = components(links(distinct, radius))
    return distinct.join(found, distinct.fingerprint == found.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def _row(df: DataFrame) -> Column:
    """A hash of a whole row (but for maps, which have no order)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def _rows(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, row, fingerprint) of every row, written once."""
    known = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 60)))
    return checkpoint(fingerprints(df.select(known.alias("id"), _row(df).alias("row"), F.col(text).alias("text")), "text", words=words).drop("text"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """Each row's key, fingerprint and component: the least key that links reach."""
    rows = _rows(df, key, text, words)
    by_print = rows.groupBy("fingerprint").agg(F.min("id").alias("id"))
    tree = groups(rows, radius)
    first = tree.join(by_print, "fingerprint").groupBy("root").agg(F.min("id").alias("id"))
    of = tree.join(first, "root").select("fingerprint", F.col("id").alias("component_id"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return rows.join(of, "fingerprint").select(known("id").alias(key), "fingerprint", known("component_id").alias("component_id"))


#: 64-bit parts of a sketch.
PARTS = 16
#: Standard deviations by which a pair's bits may differ from the mean at the similarity before its sets aren't compared;
#: the first is of the first part, and of the first two. SLACK is what ``radius_of`` takes by itself.
FIRST_SLACK, WIDE_SLACK, SLACK = 5.5, 5.0, 2.0
#: Sets up to this size have their share of differing bits counted out; no sketch is trusted to link them.
SMALL = 64
#: Sketches of a block; a group compares two blocks.
SKETCHES = 1 << 17
#: Sets, and bytes of sets, of a side of an exact comparison.
EXACT, EXACT_BYTES = 2048, 16 << 20
#: Tiles in which shingle counts of one ratio are dealt; more of them skip more pairs and repeat more rows.
FINE = 3


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted hashes of the set of shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def sketch(text: str | None, words: int = 5) -> tuple[np.ndarray, int]:
    """PARTS fingerprints of the set of shingles under as many hashes, and the size of the set."""
    hashes = shingle_set(text, words)
    if not len(hashes):
        return np.zeros(PARTS, np.uint64), 0
    mixed = hashes[None] + np.arange(PARTS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
    return _majority(mixed ^ mixed >> np.uint64(31)), len(hashes)


def radius_of(similarity: float, bits: int, slack: float = SLACK) -> int:
    """Differing bits of two sets at a Jaccard similarity: the mean, and so many standard deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + slack * np.sqrt(bits * p * (1 - p)))


def differing(a: int, b: int, both: int) -> float:
    """The share of bits in which the majorities of sets of two sizes with so many common members differ, on average."""
    above = lambda n, least: sum(comb(n, k) for k in range(max(0, least), n + 1)) / 2**n
    out = 0.0
    for k in range(both + 1):
        x, y = above(a - both, a // 2 + 1 - k), above(b - both, b // 2 + 1 - k)
        out += comb(both, k) / 2**both * (x * (1 - y) + y * (1 - x))
    return out


@lru_cache
def radii(similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """By size of a set (all from SMALL up as SMALL): bits of the first part, the first two and the sketch beyond which no set is so similar; bits up to which all larger ones are."""
    high = np.zeros(SMALL + 1)
    for a in range(1, SMALL + 1):
        for b in range(a, int(a / similarity + 1e-9) + 1):
            for both in range(ceil(similarity * (a + b) / (1 + similarity) - 1e-9), a + 1):
                p = differing(a, b, both)
                high[a] = max(high[a], p)
                if b <= SMALL:
                    high[b] = max(high[b], p)
    limit = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    high = np.maximum(high, limit)
    of = lambda bits, slack: (bits * high + slack * np.sqrt(bits * high * (1 - high))).astype(np.int64)
    # above SMALL the share is off its limit by less than a twentieth
    return of(64, FIRST_SLACK), of(128, FIRST_SLACK), of(64 * PARTS, WIDE_SLACK), radius_of(similarity, 64 * PARTS, -WIDE_SLACK) * 19 // 20


def sketches(df: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """Add ``sketch`` (binary) and ``shingles``."""

    @F.arrow_udf("struct<sketch:binary,shingles:long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [sketch(t.as_py(), words) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["sketch", "shingles"])

    return df.withColumn("_both", of(F.col(text))).select("*", "_both.sketch", "_both.shingles").drop("_both")


def similar_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Sets (id, sketch, shingles) that are so similar, or may be, by their sketches.

    Rows with a group of null are links (a, b) that span what sketches connect for sure. In each other group stand the sets (a) of pairs
    about which the sketches can't tell, apart by side (home): at most EXACT of a side, and each set once, however many pairs it is in.

    Sets can be so similar only if one has at most 1/similarity times the other's shingles: FINE tiles
    make up a range of this ratio, and a set meets those of its own tile and of the next FINE ones up.
    """
    ratio = float(-np.log(similarity)) / FINE
    near, nearer, close, trusted = radii(similarity)
    tile = F.floor(F.log(F.greatest("shingles", F.lit(1))) / F.lit(ratio) + F.lit(1e-9)).cast("long")
    rows = rows.withColumn("tile", tile)
    sizes = {r.tile: r.n for r in rows.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # a hundred ranges reach to billions of shingles
    blocks = {t: -(-n // SKETCHES) for t, n in sizes.items()}
    guests = {t: -(-sum(sizes.get(t - k, 0) for k in range(FINE + 1)) // SKETCHES) for t in sizes}
    if not sizes:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("group"), F.lit(True).alias("home"))
    pick = lambda table, t: F.coalesce(F.create_map(*[F.lit(x).cast("long") for kv in table.items() for x in kv])[t], F.lit(0))
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    columns = ["id", "sketch", "shingles"]
    spread = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")))))
    home = rows.select(*columns, F.col("tile"), (mixed % pick(blocks, F.col("tile"))).alias("block"), spread(pick(guests, F.col("tile"))).alias("guest"), F.lit(True).alias("home"))
    visit = rows.select(*columns, F.explode(F.sequence("tile", F.col("tile") + FINE)).alias("tile")).where(pick(blocks, F.col("tile")) > 0)
    visit = visit.select(*columns, "tile", spread(pick(blocks, F.col("tile"))).alias("block"), (mixed % pick(guests, F.col("tile"))).alias("guest"), F.lit(False).alias("home"))
    keys = ["tile", "block", "guest"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # of the next group
        for group in sorted_groups(batches, *keys):
            wide = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(-1, PARTS)
            ids, is_home, sizes = group["id"], group["home"].astype(bool), np.minimum(group["shingles"], SMALL)
            own, others = np.flatnonzero(is_home), np.flatnonzero(~is_home)
            if not len(own) or not len(others):
                continue
            side = max(1, min(EXACT, EXACT_BYTES // (8 * max(1, int(group["shingles"].max())))))
            asked, guests = np.zeros((len(own), -(-len(others) // side)), bool), np.zeros((len(others), -(-len(own) // side)), bool)
            every_id, node = np.unique(ids, return_inverse=True)
            sure = np.arange(len(every_id))  # what sure links connect
            first, reach = np.ascontiguousarray(wide[others, 0]), near[sizes[others]]
            for i in range(0, len(own), STRIP):
                x, y = np.nonzero(np.bitwise_count(wide[own[i : i + STRIP], :1] ^ first) <= reach)
                x += i
                u, v = own[x], others[y]
                ok = np.bitwise_count(wide[u, 1] ^ wide[v, 1]) + np.bitwise_count(wide[u, 0] ^ first[y]) <= nearer[sizes[v]]
                ok &= sure[node[u]] != sure[node[v]]
                x, y = x[ok], y[ok]
                for k in range(0, len(x), 1 << 16):
                    u, v = own[x[k : k + (1 << 16)]], others[y[k : k + (1 << 16)]]
                    bits = np.bitwise_count(wide[u] ^ wide[v]).sum(axis=1, dtype=np.int64)
                    certain = (bits <= trusted) & (sizes[u] == SMALL) & (sizes[v] == SMALL)
                    link, sure = spanning(node[u], node[v], bits, certain, sure)
                    if len(link):
                        yield out(every_id[np.maximum(node[u[link]], node[v[link]])], every_id[np.minimum(node[u[link]], node[v[link]])])
                    maybe = k + np.flatnonzero(~certain & (bits <= close[sizes[v]]) & (sure[node[u]] != sure[node[v]]))
                    asked[x[maybe], y[maybe] // side] = True
                    guests[y[maybe], x[maybe] // side] = True
            for h in range(guests.shape[1]):
                mine = slice(h * side, (h + 1) * side)
                for g in np.flatnonzero(asked[mine].any(axis=0)).tolist():
                    theirs = slice(g * side, (g + 1) * side)
                    for home, which in ((True, own[mine][asked[mine, g]]), (False, others[theirs][guests[theirs, h]])):
                        yield out(ids[which], None, number, home)
                    number += 1

    def out(a: np.ndarray, b: np.ndarray | None, group: int | None = None, home: bool | None = None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.array([group] * n, pa.int64()), pa.array([home] * n, pa.bool_())], ["a", "b", "group", "home"])

    return home.unionByName(visit).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, group long, home boolean")


def spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray, ok: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of links a-b that join what bears different labels, the closest first and none in a circle; the labels then."""
    found = []
    at = np.flatnonzero(ok)
    at = at[np.argsort(bits[at], kind="stable")]
    while len(at := at[label[a[at]] != label[b[at]]]):
        high, low = np.maximum(label[a[at]], label[b[at]]), np.minimum(label[a[at]], label[b[at]])
        hung, which = np.unique(high, return_index=True)  # each label hangs on a smaller one
        found.append(at[which])
        to = np.arange(len(label))
        to[hung] = low[which]
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    return (np.concatenate(found) if found else at), label


def keep_one_similar(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The row with the least key of each component of documents with so similar shingle sets, with all its columns.

    Sketches of PARTS times 64 bits tell which sets may be so similar: a pair is passed over only if its bits differ by WIDE_SLACK
    (in the first part and the first two FIRST_SLACK) standard deviations more than those of any pair at the similarity. Large sets whose bits differ by
    WIDE_SLACK less link; for all others the shingle sets themselves are compared, block by block, so that what is sent
    are sets, never pairs.
    """
    known = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 60)))
    named = df.select(known.alias("key"), _row(df).alias("row"), F.col(text).alias("text"))
    rows = checkpoint(sketches(named, "text", words).drop("text"))
    equal = rows.groupBy("sketch", "shingles").agg(F.min(F.struct("key", "row")).alias("best"))
    sets = checkpoint(checkpoint(equal).withColumn("id", F.monotonically_increasing_id()))
    found = checkpoint(similar_links(sets.select("id", "sketch", "shingles"), similarity))
    tree = components(found.where("group is null").select("a", "b").union(_exact(found.where("group is not null"), sets, named, words, similarity)))
    best = sets.join(tree, sets.id == tree.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best"))
    return _of_rows(df, best.select("best.row"))


def _exact(asked: DataFrame, sets: DataFrame, named: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that span what the shingle sets of each group's two sides connect at the similarity; only these texts are read into sets."""

    @F.arrow_udf("binary")
    def members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch], pa.binary())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "group"):
            held, home = [np.frombuffer(x, np.uint64) for x in group["members"]], group["home"].astype(bool)
            ids, node = np.unique(group["id"], return_inverse=True)
            others = np.flatnonzero(~home)
            label, sizes = np.arange(len(ids)), np.array([len(held[i]) for i in others], np.int64)
            owner, values = np.repeat(np.arange(len(others)), sizes), np.concatenate([np.zeros(0, np.uint64), *(held[i] for i in others)])
            order = np.argsort(values, kind="stable")
            owner = owner[order]
            keys, starts, lengths = np.unique(values[order], return_index=True, return_counts=True)
            for i in np.flatnonzero(home).tolist():
                apart = label[node[others]] != label[node[i]]
                if not apart.any() or not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, held[i]), len(keys) - 1)
                at = at[keys[at] == held[i]]
                both = np.bincount(take_ranges(owner, starts[at], lengths[at]), minlength=len(others))
                linked = others[apart & (both >= similarity * (len(held[i]) + sizes - both))]
                labels, one = np.unique(label[node[linked]], return_index=True)
                if len(labels):
                    a, b = np.full(len(one), group["id"][i]), group["id"][linked[one]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
                    joined = [*labels.tolist(), int(label[node[i]])]
                    label[np.isin(label, joined)] = min(joined)

    of = sets.join(asked.select(F.col("a").alias("id")).distinct(), "id").select("id", F.col("best.row").alias("row"))
    texts = named.select("row", "text").join(of, "row").dropDuplicates(["id"])
    held = checkpoint(texts.select("id", members(F.col("text")).alias("members")))
    return asked.select("group", "home", F.col("a").alias("id")).join(held, "id").repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")


def _of_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of df for each of some marks of rows (of ``_row``), with all its columns, whatever their names."""
    mark = "_" * (1 + max(map(len, df.columns)))  # longer than any other column's name
    return df.withColumn(mark, _row(df)).join(rows.toDF(mark), mark, "left_semi").dropDuplicates([mark]).drop(mark)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The row of each component with the least key, with all its columns."""
    rows = _rows(df, key, text, words)
    by_print = rows.groupBy("fingerprint").agg(F.min(F.struct("id", "row")).alias("best"))
    tree = groups(rows, radius)
    best = tree.join(by_print, "fingerprint").groupBy("root").agg(F.min("best").alias("best"))
    return _of_rows(df, best.select("best.row"))

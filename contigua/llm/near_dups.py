"""Near-duplicate texts: sets of word shingles that resemble each other by 0.8 or more, SimHash first.

1. Texts become sets of shingles, repeats counted once; texts of equal sets, by a 64-bit digest, are one node.
2. SimHash fingerprints of the sets go through the Gray-order index of contigua.llm.simhash. What it finds within NEAR bits is
   compared by the whole sets and linked, so that groups of near copies mostly become one here.
3. Pairs of resemblance 0.8 are 10 of 64 bits apart on average, which no fingerprint search reaches. So sets are sorted by one
   order, rare shingles first: two sets that resemble each other share a shingle of their prefixes. Nodes that meet there and are
   not linked yet are compared along trees first, so that large groups become one; then all pairs whose places, sizes and parity
   sketches allow it. Again whole sets decide. But for equal 64-bit hashes no link is lost or made by chance.

A shingle that over BLOCK nodes have is cut: its nodes are dealt to blocks by hash, trees grow within blocks, and each pair of
blocks is a group of its own when all pairs are compared. Groups whose nodes are all linked by then leave before.
So no task holds more than two blocks of a shingle. Where a large group's texts stay apart, comparing them grows with its square.

Defined cases: a null text is the empty text; all texts without a word are copies of each other; fewer words than a shingle has
make one shingle; repeated rows are copies; rows with a null key belong to no group. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, text_bytes, written
from contigua.llm.components import components
from contigua.llm.simhash import LOWER, SEED, drop_pairs, fingerprint, near_pairs, shingle_hashes

SIZE, LEAST = 5, 0.8
#: Differing bits up to which the Gray-order index proposes pairs.
NEAR = 3
#: Leading bits of a shingle's hash by which shingles are counted.
CELL_BITS, CHUNKS = 20, 256
#: Arms of the trees along which nodes with a shared shingle are compared first, and number of trees, each in another order.
ARMS, TREES = 64, 4
#: Most nodes with a shared shingle that are held at once.
BLOCK = 16384
#: Words of a sketch of a set.
PARITY = 4
_ODD = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_P = [f"p{i}" for i in range(PARITY)]
#: Nodes of a group that are compared by their distance in it; more are compared one with all.
FEW = 64


def resemblance(a: bytes, b: bytes, size: int = SIZE) -> float:
    """Shared shingles of two texts as a part of all; 1 of two texts without words."""
    x, y = (set(shingle_hashes(t, size).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def rolled_hashes(text: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of each word shingle, repeats included, made of the hashes of its words, so that each word is hashed once; equal shingles have equal ones."""
    words = text.translate(LOWER).split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    wide = min(size, len(each))
    if not wide:
        return each
    many = len(each) - wide + 1
    out = np.full(many, wide, np.uint64)
    for i in range(wide):
        # the place of a word in the shingle counts: each has another odd factor
        out += each[i : i + many] * np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) | 1)
    for _ in range(2):
        out ^= out >> np.uint64(32)
        out *= _MIX
    return out ^ (out >> np.uint64(32))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    every = np.sort(rolled_hashes(text, size))
    return every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def needed(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Shingles that sets of x and y shingles share at least when they resemble each other by `least`."""
    return np.ceil(least / (1 + least) * (x + y) - 1e-9).astype(np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles, rare ones first, of which a set shares one at least with each set that resembles it by `least`.

    common has counts by the leading bits of the hash. Any order that all sets go by gives the same links; only the work depends on it.
    """
    n = len(shingles)
    if not n:
        return shingles
    order = np.lexsort((shingles, common[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
    return shingles[order[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """A sketch of PARITY words: for each of its bits whether an odd number of shingles falls to it. Sketches differ in no more bits than sets in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of numbers, sorted by the first column, as arrays that cut no group."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        if not len(rows):
            continue
        if held and held[0][0, 0] == rows[-1, 0]:
            held.append(rows)
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if held or last:
            yield np.concatenate([*held, rows[:last]])
        held = [rows[last:]]
    if held:
        yield np.concatenate(held)


def _group_sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return starts, np.diff(np.r_[starts, len(key)])


#: Columns of the rows that meet by a shared shingle: the group, node and root, shingles of the set, place of the shingle in its prefix, half of the group.
GROUP, NODE, ROOT, SHINGLES, PLACE, HALF, SKETCH = range(7)


def _may(rows: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets of rows x and y can resemble each other when this shingle is the first they share."""
    need = needed(rows[x, SHINGLES], rows[y, SHINGLES], least)
    can = need <= np.minimum(rows[x, SHINGLES] - rows[x, PLACE], rows[y, SHINGLES] - rows[y, PLACE])
    if rows.shape[1] > SKETCH:
        at = np.flatnonzero(can)
        apart = np.bitwise_count((rows[x[at], SKETCH:] ^ rows[y[at], SKETCH:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        can[at] = apart <= (rows[x, SHINGLES] + rows[y, SHINGLES] - 2 * need)[at]
    return can


def trees(rows: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of groups of several nodes, and for each of TREES orders the node above each row's in a tree of ARMS arms, where the two may resemble each other, or its own."""
    starts, sizes = _group_sizes(rows[:, GROUP])
    rows = rows[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    at, first = np.arange(len(rows)), np.repeat(np.cumsum(sizes) - sizes, sizes)
    above = np.where(at > first, first + (at - first - 1) // ARMS, at)
    found = []
    for odd in _ODD[:TREES]:
        order = np.lexsort((rows[:, NODE].view(np.uint64) * odd, first))
        up = np.empty_like(order)
        up[order] = order[above]
        found.append(rows[np.where(_may(rows[:, :SKETCH], at, up, least), up, at), NODE])
    return rows, found


def cross_pairs(rows: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """All pairs of nodes of a group that may resemble each other and are not linked yet; only pairs across its halves where it has two."""
    starts, sizes = _group_sizes(rows[:, GROUP])
    mixed = np.minimum.reduceat(rows[:, ROOT], starts) != np.maximum.reduceat(rows[:, ROOT], starts)
    few = mixed & (sizes <= FEW)
    rest = rows[np.repeat(few, sizes)]
    for d in range(1, int(sizes[few].max(initial=1))):
        x = np.flatnonzero((rest[:-d, GROUP] == rest[d:, GROUP]) & (rest[:-d, ROOT] != rest[d:, ROOT]) & ((rest[:-d, HALF] == 0) | (rest[:-d, HALF] != rest[d:, HALF])))
        yield np.stack([rest[x, NODE], rest[x + d, NODE]], axis=1)[_may(rest, x, x + d, least)]
    for s, m in zip(starts[mixed & ~few].tolist(), sizes[mixed & ~few].tolist(), strict=True):
        part = rows[s : s + m]
        part = part[np.argsort(part[:, SHINGLES], kind="stable")]
        for x in range(m - 1):
            # sorted by size, the sets that are not too large for this one are a run
            end = int(np.searchsorted(part[:, SHINGLES], part[x, SHINGLES] / least + 1e-6, "right"))
            y = np.arange(x + 1, max(end, x + 1))
            y = y[(part[y, ROOT] != part[x, ROOT]) & ((part[x, HALF] == 0) | (part[y, HALF] != part[x, HALF]))]
            y = y[_may(part, np.full(len(y), x), y, least)]
            yield np.stack([np.full(len(y), part[x, NODE]), part[y, NODE]], axis=1)


_PAIR = "a long, b long"


def _grouped(df: DataFrame, key: str, text: str, size: int, least: float, block: int = BLOCK) -> DataFrame:
    """doc, digest (of the text), node (of its shingle set) and root of each row with a key; rows of one root are linked."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for x in text_bytes(b.column(1)):
                cells = (rolled_hashes(x, size) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                if len(cells) > 1 << 14:
                    seen += np.bincount(cells, minlength=1 << CELL_BITS)
                else:
                    np.add.at(seen, cells, 1)
        yield packed(seen.reshape(CHUNKS, -1))

    def packed(counts: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(counts.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.minimum(counts[i], (1 << 31) - 1).astype(np.int32).tobytes() for i in some], pa.binary())], ["chunk", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CHUNKS, (1 << CELL_BITS) // CHUNKS), np.int64)
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                total[i] += np.frombuffer(x, np.int32)
        yield packed(total)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, size) for x in text_bytes(b.column(1))]
            sketch = np.array([parity(s) for s in sets], np.int64).reshape(-1, PARITY)
            fp = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            first = pa.array([prefix(s, common, least).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), first, *(pa.array(sketch[:, i]) for i in range(PARITY))], ["doc", "digest", "node", "n", "fp", "first", *_P])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, size) for x in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x, np.int64) for x in text_bytes(b.column(2))]
            many = np.array([len(x) for x in each], np.int64)
            repeat = pa.array(np.repeat(np.arange(len(each)), many))
            place = [np.arange(m, dtype=np.int32) for m in many.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *each])), b.column(0).take(repeat), b.column(1).take(repeat), pa.array(np.concatenate([np.zeros(0, np.int32), *place]))], ["shingle", "node", "n", "place"])

    ups = [f"above{i}" for i in range(TREES)]

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            rows, above = trees(rows, least)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, SKETCH]), pa.array(rows[:, NODE]), *(pa.array(rows[:, i].astype(np.int32)) for i in (SHINGLES, PLACE, SKETCH + 1)), *(pa.array(x) for x in above)], ["shingle", "node", "n", "place", "size", *ups])

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            for found in cross_pairs(rows, least):
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], ["a", "b"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(*(text_bytes(b.column(i)) for i in (2, 3)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared / (len(x) + len(y) - shared) >= least if len(x) and len(y) else len(x) == len(y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    scratch: list[DataFrame] = []
    keep = lambda frame, what: scratch.append(written(frame, what)) or scratch[-1]
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("digest"))
    counts = docs.select("doc", "text").mapInArrow(tally, "chunk int, counts binary").repartition("chunk").mapInArrow(summed, "chunk int, counts binary").toArrow()
    common = np.zeros((CHUNKS, (1 << CELL_BITS) // CHUNKS), np.int32)
    for i, x in zip(counts["chunk"].to_pylist(), counts["counts"].to_pylist(), strict=True):
        common[i] = np.frombuffer(x, np.int32)
    common = common.ravel()
    every = written(docs.mapInArrow(prints, "doc long, digest long, node long, n int, fp long, first binary, " + ", ".join(f"{p} long" for p in _P)), "sets")
    nodes = keep(every.groupBy("node").agg(F.min(F.struct("doc", "digest")).alias("one"), *(F.first(c).alias(c) for c in ("n", "fp", *_P))), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets resemble each other; one text of each node is read, and only of those that are asked for."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        whose = nodes.join(asked, "node", "left_semi").select("one.doc", "one.digest")
        sets = written(docs.join(whose, ["doc", "digest"], "left_semi").select("doc", "text").mapInArrow(sets_of, "node long, shingles binary").dropDuplicates(["node"]), "sets")
        side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_shingles"))
        out = keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_shingles", "b_shingles").mapInArrow(checked, _PAIR), "links")
        drop_written(sets)
        return out

    # what the Gray-order index finds; sets of equal fingerprints are all compared with the first of them
    fps = keep(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    close = near_pairs(fps.select("fp"), NEAR)
    by_bits = close.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    same = nodes.select("node", "fp").join(fps, "fp").where("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y"))
    found = by_bits.unionAll(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    # the shingles of prefixes; those that over `block` nodes have are known before anything is dealt by shingle
    places = keep(every.select("node", "n", "first").dropDuplicates(["node"]).mapInArrow(spread, "shingle long, node long, n int, place int"), "places")
    large = keep(places.groupBy("shingle").agg(F.count("*").cast("int").alias("size")).where(F.col("size") > block), "large")
    order = ("grp", "node", "root", "n", "place", "half")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "shingle"), blocks).cast("int")
    dealt = lambda rows: rows.repartition("grp").sortWithinPartitions("grp", "node")

    sized = places.join(large, "shingle", "left").withColumn("grp", F.when(F.col("size").isNull(), F.col("shingle")).otherwise(F.xxhash64("shingle", own)))
    rows = sized.select("grp", "node", F.col("node").alias("root"), "n", "place", F.lit(0).alias("half"), "shingle", F.coalesce("size", F.lit(0)).alias("size"))
    met = keep(dealt(rows).mapInArrow(climb, "shingle long, node long, n int, place int, size int, " + ", ".join(f"{u} long" for u in ups)), "places")
    along = met.select("node", F.explode(F.array(*ups)).alias("above")).where("node <> above").select(F.least("node", "above").alias("a"), F.greatest("node", "above").alias("b"))
    tried = keep(found.unionAll(along).distinct(), "pairs")
    drop_pairs(close)
    links = verified(tried)

    now = keep(nodes.select("node", *_P).join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    labelled = met.select("shingle", "node", "n", "place", "size").join(now, "node")
    small = labelled.where("size = 0").withColumn("half", F.lit(0)).withColumnRenamed("shingle", "grp").select(*order, *_P)
    # of large groups those of one root leave; each pair of blocks of the others is a group: rows of the lower block are its half 1, those of the other its half 2
    several = labelled.where("size > 0").groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    cut = labelled.where("size > 0").join(several, "shingle", "left_semi").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cut = cut.withColumn("half", half).withColumn("grp", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))).select(*order, *_P)
    pairs = dealt(small.unionAll(cut)).mapInArrow(crossing, _PAIR).distinct()
    pairs = keep(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    linked = components(links.unionAll(verified(pairs)))
    for done in scratch:
        drop_written(done)
    return every.select("doc", "digest", "node").join(linked, "node", "left").select("doc", "digest", "node", F.coalesce("root", "node").alias("root"))


def resembling_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """key and component_id of each row with a key: links are texts whose sets of word shingles resemble each other by `least` or more."""
    every = _grouped(df, key, text, size, least, block)
    smallest = every.groupBy("root").agg(F.min("doc").alias("component_id"))
    return every.join(smallest, "root").select(F.col("doc").alias(key), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """One row of df, with all columns, of each group: one with the smallest key and, of its texts in the group, that of the smallest digest.

    Rows that repeat a key with another text stand for themselves; of rows that repeat both any one stays. Rows with a null key stay.
    """
    every = _grouped(df.select(key, text), key, text, size, least)
    chosen = every.groupBy("root").agg(F.min(F.struct("doc", "digest")).alias("x")).select("x.doc", "x.digest")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    kept = rows.join(chosen, ["doc", "digest"], "left_semi").dropDuplicates(["doc", "digest"]).select("row.*")
    return kept.unionAll(df.where(F.col(key).isNull()))

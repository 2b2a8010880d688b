"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: the XXH64 values of a text's word shingles vote on each of 64 bits. Equal fingerprints are
merged first, so that groups of copies cost one row. The others are sorted by Gray rank, in which neighbours share long bit
patterns, and cut into ranges of at most RANGE. Over each range stand nodes of FANOUT children that hold the bits that all
below share. A search goes from the top, adds at each node only the differences in bits that the nodes above
did not fix yet, and drops whole groups once these exceed the bits allowed.

Up to RANGE fingerprints are one range. Beyond that the top nodes are spread over tasks: each is a range's first bits, as many as make
ranges fit. A partner may differ in these, so there are d + 1 orders for links of at most d bits, each with another
segment of the 64 bits first: partners agree on one segment at least, where no difference is added at the top
node, so a fingerprint goes to one range of each order, not to all that d differences leave open. Ranges that are still too
large are cut again by whole segments of the bits that are not fixed yet; as fingerprints differ, this ends, and no task
holds more than a range. A range passes on a spanning forest of its links, not every pair.

Defined cases: a null text is the empty text; texts without a word have fingerprint zero and are linked
like others; fewer words than a shingle has make one shingle; repeated rows and repeated keys give a row each;
rows with a null key get a fingerprint, but a null component, and link nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, joined, text_bytes, written
from contigua.llm.components import components

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Most fingerprints of a range, which one search takes at once.
RANGE = 8192
#: Children of a node, and fingerprints of a leaf.
FANOUT = 4
#: Shingles whose bits are counted at once.
STEP = 1 << 15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of a lower-cased text, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """key and fp, the fingerprint as a signed 64-bit number, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(shingle_hashes(x, size)) for x in text_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Nodes over Gray-ordered fingerprints; masks[h], values[h]: the bits that all below a node of height h share.

    looked[h]: how many nodes of height h searches have looked at so far.
    """

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        every, some = self.fps, self.fps
        self.masks, self.values = [np.full(len(fps), ~np.uint64(0))], [self.fps]
        while len(every) > 1:
            starts = np.arange(0, len(every), FANOUT)
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            self.masks.append(every | ~some)
            self.values.append(every)
        self.looked = [0] * len(self.masks)

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in the order given) at most `most` bits apart, each once, for some queries at a time."""
        n, top = len(self.fps), len(self.masks) - 1
        for first in range(0, n, 1024):
            query = np.arange(first, min(n, first + 1024), dtype=np.int32)
            node, apart = np.zeros(len(query), np.int32), np.zeros(len(query), np.uint8)
            for h in range(top, -1, -1):
                if h < top:
                    query, apart = np.repeat(query, FANOUT), np.repeat(apart, FANOUT)
                    known = np.repeat(self.masks[h + 1][node], FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT, dtype=np.int32)).ravel()
                    # each pair once: groups wholly before the query hold no partner to report
                    keep = np.flatnonzero((node < len(self.masks[h])) & ((node + 1) * np.int64(FANOUT**h) > query))
                    query, node, apart, known = query[keep], node[keep], apart[keep], known[keep]
                else:
                    known = np.zeros(len(query), np.uint64)
                self.looked[h] += len(node)
                apart = apart + np.bitwise_count((self.fps[query] ^ self.values[h][node]) & self.masks[h][node] & ~known)
                keep = np.flatnonzero(apart <= most)
                query, node, apart = query[keep], node[keep], apart[keep]
            keep = node > query
            yield self.order[query[keep]], self.order[node[keep]]


class Forest:
    """Disjoint sets of small numbers; join() tells whether two sets became one."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Places of a spanning forest of the links between the fingerprints."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= most else []
    forest = Forest(len(fps))
    return [(a, b) for x, y in GrayIndex(fps).pairs(most) for a, b in zip(x.tolist(), y.tolist(), strict=True) if forest.join(a, b)]


def _segments(free: int, parts: int, lead: int) -> list[int]:
    """The first `lead` bits of each of `parts` runs of nearly equal size of the set bits of a mask, as masks."""
    bits = [i for i in range(63, -1, -1) if free >> i & 1]
    runs = [bits[k * len(bits) // parts : (k + 1) * len(bits) // parts] for k in range(parts)]
    return [sum(1 << i for i in run[:lead]) for run in runs]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ranges(rows: DataFrame, fixed: list[int], deeper: list[list[int]]) -> DataFrame:
    """rows (fp, way) -> a row (fp, way, value) for each mask that goes deeper; ways number the masks in order."""
    parts = len(deeper[0])
    ways = F.create_map(*(x for w, masks in enumerate(deeper) for x in (F.lit(w), F.array(*(F.struct(F.lit(w * parts + i).alias("way"), F.lit(_signed(fixed[w] | m)).alias("mask")) for i, m in enumerate(masks))))))
    return rows.select("fp", F.explode(ways[F.col("way")]).alias("x")).select("fp", F.col("x.way").alias("way"), F.expr("fp & x.mask").alias("value"))


def near_pairs(distinct: DataFrame, most: int = 2, limit: int = RANGE) -> DataFrame:
    """For distinct fingerprints (column fp): pairs (a, b) whose components are those of all links of at most `most` bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def result() -> Iterator[pa.RecordBatch]:
            v = np.concatenate(held) if held else np.zeros(0, np.int64)
            if len(v) > 1 and (pairs := links(v.view(np.uint64), most)):
                i = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(v[i[:, 0]]), pa.array(v[i[:, 1]])], ["a", "b"])

        for b in batches:
            fp, way, value = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero((way[1:] != way[:-1]) | (value[1:] != value[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if s == e:
                    continue
                if (way[s], value[s]) != key:
                    yield from result()
                    held, key = [], (way[s], value[s])
                held.append(fp[s:e].astype(np.int64))
        yield from result()

    searched = lambda rows: written(rows.repartition("way", "value").sortWithinPartitions("way", "value", "fp").mapInArrow(search, "a long, b long"), "links")
    rows = distinct.select("fp", F.lit(0).alias("way"), F.lit(0).cast("long").alias("value"))
    largest, fixed, found, scratch = distinct.count(), [0], [], []
    if largest <= limit:
        return searched(rows)
    while largest > limit:
        # first as many bits as even ranges need; what is crowded then is cut by whole segments
        lead = (4 * largest // limit).bit_length() if fixed == [0] else 64
        deeper = [_segments(~m & (1 << 64) - 1, most + 1, lead) for m in fixed]
        rows = _ranges(rows, fixed, deeper)
        fixed = [f | m for f, masks in zip(fixed, deeper, strict=True) for m in masks]
        size = written(rows.groupBy("way", "value").agg(F.count("*").alias("n")).where("n > 1"), "ranges")
        rows = rows.join(size, ["way", "value"])
        found.append(searched(rows.where(F.col("n") <= limit).select("fp", "way", "value")))
        largest = size.agg(F.max("n")).first()[0] or 0
        if largest > limit:
            rows = written(rows.where(F.col("n") > limit).select("fp", "way", "value"), "ranges")
            scratch.append(rows)
        scratch.append(size)
    for s in scratch:
        drop_written(s)
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    out.parts = found
    return out


def drop_pairs(pairs: DataFrame) -> None:
    """Deletes the tables behind a result of near_pairs()."""
    for p in getattr(pairs, "parts", [pairs]):
        drop_written(p)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, most: int = 2) -> DataFrame:
    """key, fp and component_id, the smallest key reachable by links of at most `most` differing bits, of each row."""
    all_fps = written(fingerprints(df, key, text, size), "fingerprints")
    least = written(all_fps.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "fingerprints")
    pairs = near_pairs(least.select("fp", "least"), most)
    by_id = pairs.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    roots = components(by_id.select(F.col("x").alias("a"), F.col("y").alias("b")))
    drop_pairs(pairs)
    label = written(least.join(roots, F.col("least") == F.col("node"), "left").select("fp", F.coalesce("root", "least").alias("component_id"), "n"), "labels")
    names = (key, "fp", "component_id")
    told = joined(all_fps.where(F.col(key).isNotNull()), label, "fp").select(*names)
    return told.unionAll(all_fps.where(F.col(key).isNull()).withColumn("component_id", F.lit(None)).select(*names))


def hex_fp(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

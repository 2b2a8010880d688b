"""Bloom filters over k-mers of one length: one slice of bits for each hash, and filters that grow.

For exact results DataFrames need none: see operators.kmers.without_first. These serve membership tests whose size must be bounded.

Filters of tables have parts of some PART k-mers, to which k-mers are dealt by a hash; each part is a filter of its own. So k-mers are exchanged once, be they added or
asked, and a task holds one part, while parts grow in number with the k-mers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.functions import hashing, packed
from contigua.operators.storage import written

GROWTH, TIGHTENING = 2, 0.9
#: k-mers whose filter may go to the driver and the tasks: some 1.8 MB there.
IN_MEMORY = 1_000_000
#: k-mers of a part of a filter that is a table: some 2 MB.
PART = 1 << 20


class BloomFilter:
    """ceil(log2(1 / error)) slices of capacity / ln 2 bits; hash i has the seed i + seed."""

    def __init__(self, capacity: int, error: float = 0.001, seed: int = 0, empty: bool = False):
        self.capacity, self.error, self.seed, self.count = capacity, error, seed, 0
        self.slices = math.ceil(math.log2(1 / error))
        self.slice_size = math.ceil(capacity / math.log(2))
        self.bits = np.zeros(0 if empty else self.slices * self.slice_size, bool)

    def slice_places(self, data: np.ndarray, k: int, i: int) -> np.ndarray:
        """Places of the bits of packed k-mers in slice i."""
        return (hashing.packed_hashes(data, k, i + self.seed) % np.uint64(self.slice_size)).astype(np.int64) + i * self.slice_size

    def places(self, kmers: list[str]) -> np.ndarray:
        """k-mers x slices: places of their bits."""
        data, k = hashing.packed(kmers), len(kmers[0])
        return np.stack([self.slice_places(data, k, i) for i in range(self.slices)], axis=1)

    @property
    def full(self) -> bool:
        return self.count >= self.capacity

    def add(self, kmers: list[str]) -> None:
        if kmers:
            self.bits[self.places(kmers)] = True
            self.count += len(kmers)

    def check(self, kmers: list[str]) -> np.ndarray:
        return self.bits[self.places(kmers)].all(axis=1) if kmers else np.zeros(0, bool)

    def add_packed(self, data: np.ndarray, k: int) -> None:
        for i in range(self.slices):
            self.bits[self.slice_places(data, k, i)] = True
        self.count += len(data)

    def check_packed(self, data: np.ndarray, k: int) -> np.ndarray:
        """Slice by slice, of those that all slices before have."""
        left = np.arange(len(data))
        for i in range(self.slices):
            left = left[self.bits[self.slice_places(data[left], k, i)]]
        out = np.zeros(len(data), bool)
        out[left] = True
        return out


class ScalableBloomFilter:
    """Filters of growing capacity and falling error; the last takes what is added, all are asked."""

    def __init__(self, capacity: int, error: float = 0.001, seed: int = 0):
        self.capacity, self.error, self.seed = capacity, error, seed
        self.filters = [BloomFilter(capacity, error, seed)]

    def add(self, kmers: list[str]) -> None:
        at = 0
        while at < len(kmers):
            last = self._last()
            part = kmers[at : at + last.capacity - last.count]
            last.add(part)
            at += len(part)

    def add_packed(self, data: np.ndarray, k: int) -> None:
        at = 0
        while at < len(data):
            last = self._last()
            part = data[at : at + last.capacity - last.count]
            last.add_packed(part, k)
            at += len(part)

    def _last(self) -> BloomFilter:
        """The filter that takes what comes next."""
        if self.filters[-1].full:
            n = len(self.filters)
            self.filters.append(BloomFilter(self.capacity * GROWTH**n, self.error * TIGHTENING**n, self.seed + n))
        return self.filters[-1]

    def check(self, kmers: list[str]) -> np.ndarray:
        return np.logical_or.reduce([f.check(kmers) for f in self.filters])


def sizes(capacity: int, error: float, n: int) -> list[tuple[int, float]]:
    """Capacity and error of the first n filters of a growing one."""
    return [(capacity * GROWTH**i, error * TIGHTENING**i) for i in range(n)]


def _data(kmers: pa.Array, k: int | None) -> tuple[np.ndarray, int]:
    """Packed k-mers and k, of strings or, with k, of words of functions.packed."""
    if k is not None:
        return hashing.packed_words(kmers.to_numpy().view(np.uint64), k), k
    texts = kmers.to_pylist()
    return hashing.packed(texts), len(texts[0])


def _part(parts: int) -> Column:
    """The part of the column kmer; not by the hash that exchanges use."""
    return F.pmod(F.xxhash64("kmer", F.lit(1)), F.lit(parts)).cast("int")


def _words(parts: int, kmers: DataFrame, make: Callable[[], ScalableBloomFilter | BloomFilter], k: int | None) -> DataFrame:
    """part, parts, filter and bits: the filters of the parts of the column kmer; k-mers that are there again are added once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, ScalableBloomFilter | BloomFilter] = {}
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            part, kmer = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            data, n = _data(b.column(1), k)
            new = np.r_[kmer[0] != last, kmer[1:] != kmer[:-1]]
            last = kmer[-1]
            for p in np.unique(part).tolist():
                if p not in own:
                    own[p] = make()
                own[p].add_packed(data[new & (part == p)], n)
        for p, found in own.items():
            # one filter a batch, as a batch goes to the JVM whole
            for i, f in enumerate(found.filters if isinstance(found, ScalableBloomFilter) else [found]):
                bits = np.packbits(f.bits, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (p, parts, i)), pa.array([bits], pa.binary())], ["part", "parts", "filter", "bits"])

    # a task holds one part, so k-mers alone are sorted
    rows = kmers.select(_part(parts).alias("part"), "kmer").repartitionById(parts, F.col("part")).sortWithinPartitions("kmer")
    return rows.mapInArrow(run, "part int, parts int, filter int, bits binary")


def growing(kmers: DataFrame, capacity: int, error: float = 0.001, seed: int = 0, k: int | None = None) -> tuple[DataFrame, int]:
    """The filters, written, that grow from `capacity` with the k-mers, for held(), and how many a part has at most.

    The filters of a part fill up one after the other, in the order of its k-mers. Nothing is collected.
    """
    parts = max(1, math.ceil(kmers.count() / PART))
    own = math.ceil(capacity / parts)
    words = written(_words(parts, kmers, lambda: ScalableBloomFilter(own, error, seed), k), "words")
    return words, (words.agg(F.max("filter")).first()[0] or 0) + 1


def whole(kmers: DataFrame, capacity: int, error: float = 0.001, seed: int = 0, k: int | None = None) -> DataFrame:
    """One filter for `capacity` k-mers, in parts, of the column kmer, for held(). Nothing is collected."""
    parts = max(1, math.ceil(capacity / PART))
    own = math.ceil(capacity / parts)
    return _words(parts, kmers, lambda: BloomFilter(own, error, seed), k)


def held(asked: DataFrame, words: DataFrame, filters: int, capacity: int, error: float = 0.001, seed: int = 0, k: int | None = None) -> DataFrame:
    """asked, rows with the column kmer, and maybe, by whole() or growing(): never false for one that was added.

    Rows meet the filters of their part in its task, which holds one part and a batch of rows.
    """
    parts = (words.select("parts").head() or [1])[0]
    shapes = sizes(math.ceil(capacity / parts), error, filters)
    names, at = asked.columns, asked.columns.index("kmer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[BloomFilter]] = {}
        for b in batches:
            part, nth = b.column(0).to_numpy(), b.column(1).to_numpy()
            # filters come before all that is asked
            first = int(np.searchsorted(nth, filters))
            for p, i, bits in zip(part[:first].tolist(), nth[:first].tolist(), b.column(2)[:first].to_pylist(), strict=True):
                f = BloomFilter(*shapes[i], seed + i, empty=True)
                f.bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little", count=f.slices * f.slice_size).view(bool)
                own.setdefault(p, []).append(f)
            if first == b.num_rows:
                continue
            rows, part = b.slice(first), part[first:]
            data, n = _data(rows.column(3 + at), k)
            maybe = np.zeros(len(data), bool)
            for p in np.unique(part).tolist():
                left = np.flatnonzero(part == p)
                for f in own.get(p, ()):
                    yes = f.check_packed(data[left], n)
                    maybe[left[yes]] = True
                    left = left[~yes]
            yield pa.RecordBatch.from_arrays([*rows.columns[3:], pa.array(maybe)], [*names, "maybe"])

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema]
    rows = asked.select(_part(parts).alias("part"), F.lit(filters).alias("filter"), F.lit(None).cast("binary").alias("bits"), *names)
    rows = rows.unionAll(words.select("part", "filter", "bits", *none)).repartitionById(parts, F.col("part")).sortWithinPartitions("filter")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return rows.mapInArrow(run, f"{kinds}, maybe boolean")


def answered(kmers: DataFrame, asked: DataFrame, capacity: int, k: int | None = None) -> DataFrame:
    """asked, rows with the column kmer, with the column maybe: whether a filter of the column kmer of kmers may hold theirs. With k, k-mers are words.

    A filter for up to IN_MEMORY k-mers goes to the tasks; a larger one stays a table. Up to PART k-mers both have the same bits.
    """
    if capacity <= IN_MEMORY:
        text = F.col("kmer") if k is None else packed.Kmer(F.lit(0), F.col("kmer"), k).text()
        return asked.withColumn("maybe", contains(build(kmers.select(text.alias("kmer")), capacity=capacity), text))
    return held(asked, written(whole(kmers, capacity, k=k), "words"), 1, capacity, k=k)


def build(kmers: DataFrame, capacity: int, error: float = 0.001, seed: int = 0) -> BloomFilter:
    """A filter of the column kmer for the driver. Tasks merge its bits; capacity bounds what is collected: answered() tells when that is too much."""
    out = BloomFilter(capacity, error, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = BloomFilter(capacity, error, seed), False
        for b in batches:
            own.add(b.column(0).to_pylist())
            some = some or b.num_rows > 0
        if some:
            word = np.packbits(own.bits, bitorder="little")
            word = np.pad(word, (0, -len(word) % 8)).view("<i8")
            at = np.flatnonzero(word)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word[at])], ["word", "bits"])

    words = kmers.select("kmer").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(-(-len(out.bits) // 64), np.uint64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    out.bits = np.unpackbits(found.astype("<u8").view(np.uint8), bitorder="little", count=len(out.bits)).astype(bool)
    out.count = kmers.count()
    return out


def contains(f: BloomFilter, kmer: Column | str) -> Column:
    """Whether the filter may hold a k-mer; never false for one that was added. The filter goes to the tasks: held() is for large ones."""
    bits, seed, capacity, error = np.packbits(f.bits, bitorder="little"), f.seed, f.capacity, f.error

    @F.pandas_udf("boolean")
    def run(s):
        if not len(s):
            return s.astype(bool)
        at = BloomFilter(capacity, error, seed, empty=True).places(s.tolist())
        return type(s)((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1), index=s.index)

    return run(F.col(kmer) if isinstance(kmer, str) else kmer)

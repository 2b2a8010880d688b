"""K-mers that occur once leave before the exchange.

A first pass sets, in each task, one slot for each k-mer by its hash, and a second one where a slot was set before. The tasks' words of slots are merged:
a slot is taken twice if a task had it twice or two tasks had it. The second pass drops, where they are read, the k-mers whose slot was not taken twice: these
are single for sure. What else is single shares a slot and leaves by the exact count, so slots change what is shuffled and no result.

repeated_of_reads() does both passes over words of reads, and makes strings of the result alone.

The sketch has SLOTS slots whatever the data; a share of about (k-mers / slots) of single ones gets through. Tasks, the broadcast and the merge hold two bits a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import windows
from contigua.operators import kmers, superkmers
from contigua.operators.storage import written

#: Slots of a sketch: 8 MiB of them as words. Slots of a word, and words that go to a merging task as one row.
SLOTS, WORD, PART = 1 << 26, 64, 1 << 13


def slot(kmer: Column | str, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col(kmer) if isinstance(kmer, str) else kmer), F.lit(slots).cast("long"))


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view("<i8")


def _checked(slots: int) -> None:
    if slots < 1 or slots % WORD:
        raise ValueError(f"slots are a multiple of {WORD}")


def _rows_of(once: np.ndarray, twice: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    """The slots of a task that were taken, and those taken twice, part by part."""
    part, a, b = min(PART, slots // WORD), _packed(once), _packed(twice)
    for p in range(0, slots // WORD, part):
        if a[p : p + part].any():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([a[p : p + part].tobytes()]), pa.array([b[p : p + part].tobytes()])], ["part", "once", "twice"])


SEEN = "part long, once binary, twice binary"


def repeated(rows: DataFrame, slots: int = SLOTS, kmer: str = "kmer") -> DataFrame:
    """word and bits: the slots that were taken twice or more; words without any are left out."""
    _checked(slots)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(slots, bool), np.zeros(slots, bool)
        for b in batches:
            at, n = np.unique(b.column(0).to_numpy(), return_counts=True)
            twice[at[(n > 1) | once[at]]] = True
            once[at] = True
        yield from _rows_of(once, twice, slots)

    return _merged(rows.select(slot(kmer, slots).alias("slot")).mapInArrow(seen, SEEN))


def word_slots(hi: np.ndarray | None, lo: np.ndarray, slots: int) -> np.ndarray:
    """The slots of k-mers as words."""
    x = lo if hi is None else lo ^ (hi + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def repeated_words(reads: DataFrame, cfg: Config, slots: int = SLOTS) -> DataFrame:
    """repeated() of the canonical k-mers of reads that have a good neighbour, by word_slots()."""
    _checked(slots)
    rows, cut = superkmers.good_words(reads, cfg)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(slots, bool), np.zeros(slots, bool)
        for b in batches:
            # nothing can be added to a full sketch
            if twice.all():
                continue
            for words in cut(b):
                at = word_slots(*words, slots)
                at.sort()
                first = windows.first_of_runs(at)
                more = np.diff(first, append=len(at)) > 1
                at = at[first]
                twice[at[more | once[at]]] = True
                once[at] = True
        yield from _rows_of(once, twice, slots)

    return _merged(rows.mapInArrow(seen, SEEN))


def _merged(found: DataFrame) -> DataFrame:
    """word and bits of the slots that a task had twice or that several had."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(0, "<i8"), np.zeros(0, "<i8")

        def result() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(twice)
            if now is not None and len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at + now), pa.array(twice[at])], ["word", "bits"])

        for batch in batches:
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                if p != now:
                    yield from result()
                    now, once, twice = p, np.zeros(len(a), "<i8"), np.zeros(len(a), "<i8")
                twice |= b | once & a
                once |= a
        yield from result()

    return found.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "word long, bits long")


def without_single(rows: DataFrame, slots: int = SLOTS, kmer: str = "kmer") -> DataFrame:
    """rows without k-mers that are single for sure. The sketch is broadcast: it has slots / 64 rows of 16 bytes at most."""
    at = slot(kmer, slots)
    words = written(repeated(rows, slots, kmer), "sketch")
    bit = F.call_function("shiftright", F.col("_bits"), F.pmod(at, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    joined = rows.withColumn("_word", F.call_function("shiftright", at, F.lit(6))).join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word")
    return joined.where(bit).select(*rows.columns)


def repeated_occurrences(occurrences: DataFrame, slots: int = SLOTS) -> DataFrame:
    """kmers.without_first() of the occurrences: all but the first one of each k-mer; most single ones are not shuffled for it."""
    return kmers.without_first(without_single(occurrences, slots))


def repeated_of_reads(reads: DataFrame, cfg: Config, slots: int = SLOTS) -> DataFrame:
    """read_id, pos and kmer of repeated_occurrences() of reads with whole numbers as read_id, over words; reads are read for each pass and so must be the same each time.

    The sketch is broadcast as an array of `slots` bits.
    """
    words = repeated_words(reads, cfg, slots).toArrow()
    bits = np.zeros(slots // WORD, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sketch = reads.sparkSession.sparkContext.broadcast(bits)

    def may_repeat(hi: np.ndarray | None, lo: np.ndarray) -> np.ndarray:
        at = word_slots(hi, lo, slots)
        return (sketch.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    return superkmers.without_first(reads, cfg, may_repeat)

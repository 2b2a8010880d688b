"""Paths of the bidirected graph of odd k up to 31, contracted in rounds that exchange only what is not whole yet.

The k - 1 bases that neighbours have in common are their junction. A node goes to the block of its left junction's minimizer and to that of its right one's, mostly the same; so all nodes of a
junction meet, and each block tells for good where paths end. What is cut off at a node that is in two blocks has that k-mer as its shared end. In each round pieces with shared ends
are dealt by one of these, with the smaller hash, and those that meet are merged; so nearly half of the shared ends go in the first round and a third in each one after. A path
that is whole leaves, and is not exchanged again.

With bins of k-mers, a step within one of the given bins is of that bin's block instead, so that the paths within a bin are walked together first.

Circles, paths that turn back in themselves, and what a block cannot hold are left over as nodes, few as a rule, for contigs.contigs() or bidirected.contig_chunks().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.functions import dna, walks
from contigua.functions.windows import U
from contigua.operators import ufx
from contigua.operators.storage import written

#: Bases of a minimizer, nodes or pieces that a task holds at once, the most of one minimizer, bases of a piece that is still merged, and rounds.
MINIMIZER, BLOCK, LARGE, LONGEST, ROUNDS = 7, 1 << 18, 1 << 22, 1 << 16, 32

NODE = "part int, word long, code short"
PIECE = "seq binary, n int, l byte, r byte, a byte, b byte"


def _part(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> U(32)).astype(np.uint32).view(np.int32)


def words(table: DataFrame, k: int) -> DataFrame:
    """word, l, r and cut (0) of the k-mers of a UFX table that are unique on both sides; rows of superkmers.unique_words() as they are."""
    if "word" in table.columns:
        return table.select("word", "l", "r", F.lit(0).cast("byte").alias("cut"))
    return of_strings(ufx.unique_both(table).select("kmer", "lmask", "rmask", F.lit(0).cast("byte").alias("cut")), k)


def of_strings(rows: DataFrame, k: int) -> DataFrame:
    """word, l, r and cut of kmer, lmask, rmask and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(16, np.int8)
        code[[1, 2, 4, 8]] = range(4)
        for b in batches:
            if b.num_rows:
                word = walks.packed(np.frombuffer("".join(b.column(0).to_pylist()).encode(), np.uint8).reshape(-1, k), k)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(code[b.column(i).to_numpy()]) for i in (1, 2)), b.column(3)], ["word", "l", "r", "cut"])

    return rows.mapInArrow(run, "word long, l byte, r byte, cut byte")


def within_bins(table: DataFrame, k: int, bin_of: Column) -> DataFrame:
    """words() of a UFX table, with ends cut where the next k-mer is of another bin: bin_of is an expression over least, a canonical k-mer."""
    rows = ufx.unique_both(table).select("kmer", "lmask", "rmask")
    binned = lambda rows, name, of: rows.withColumn("least", of).withColumn(name, bin_of).drop("least")
    before = dna.canonical(F.concat(ufx.unique_base("lmask"), F.substr("kmer", F.lit(1), F.lit(k - 1))))
    after = dna.canonical(F.concat(F.substr("kmer", F.lit(2)), ufx.unique_base("rmask")))
    for name, of in (("_own", F.col("kmer")), ("_before", before), ("_after", after)):
        rows = binned(rows, name, of)
    cut = F.when(F.col("_own") == F.col("_before"), 0).otherwise(1) + F.when(F.col("_own") == F.col("_after"), 0).otherwise(2)
    return of_strings(rows.select("kmer", "lmask", "rmask", cut.cast("byte").alias("cut")), k)


#: The bin of each of some canonical k-mers, and the bins that blocks are made of.
Bins = tuple[Callable[[np.ndarray], np.ndarray], list[int]]


def _dealt(nodes: DataFrame, k: int, bins: Bins | None = None) -> DataFrame:
    """Rows of NODE, one for each block that a node of words() is in; with bins, steps between two k-mers of one of the given bins are of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = U((1 << 2 * (k - 1)) - 1)
        for b in batches:
            if not b.num_rows:
                continue
            word, l, r, cut = (c.to_numpy() for c in b.columns)
            x = word.view(np.uint64)
            left, right = (_part(walks.minimizers(j, k - 1, MINIMIZER)) for j in (x >> U(2), x & mask))
            if bins is not None:
                bin_of, some = bins
                own = bin_of(x)
                given, part = np.isin(own, some), _part((own.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
                before, after = (np.minimum(y, walks.turned(y, k)) for y in (l.astype(U) << U(2 * k - 2) | x >> U(2), (x & mask) << U(2) | r.astype(U)))
                left, right = (np.where(given & (bin_of(y) == own), part, p) for y, p in ((before, left), (after, right)))
            # an end that is cut needs no block
            left = np.where(cut & 1, right, left)
            right = np.where(cut & 2, left, right)
            two = np.flatnonzero(left != right)
            code = (l.astype(np.int16) << 2 | r) << 4 | cut << 2
            one = code.copy()
            one[two] |= 2
            rows = np.r_[left, right[two]], np.r_[word, word[two]], np.r_[one, code[two] | 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["part", "word", "code"])

    return nodes.mapInArrow(run, NODE).repartition("part").sortWithinPartitions("part")


def _blocks(found: Callable[..., pa.RecordBatch], large: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `found` makes of blocks of rows that are sorted by their first column, a part, and of whether these hold whole parts; one with over `large` rows is cut."""
    size_of, most = BLOCK, LARGE if large is None else large
    # a row of over 64 bytes counts as several
    weight = lambda x: max(x.num_rows, x.nbytes >> 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, torn = 0, None

        def result(table: pa.Table, torn: int | None) -> Iterator[pa.RecordBatch]:
            part = table.column(0).to_numpy()
            some = np.searchsorted(part, torn, "right") if torn is not None else 0
            if some:
                yield found(table.slice(0, some), False)
            if some < len(part):
                yield found(table.slice(some), True)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += weight(b)
            if rows < size_of:
                continue
            table = pa.Table.from_batches(held)
            part = table.column(0).to_numpy()
            at = int(np.searchsorted(part, part[-1], "left"))
            if at:
                yield from result(table.slice(0, at), torn)
            rest = table.slice(at)
            if torn is not None and torn != part[-1]:
                torn = None
            if weight(rest) >= most:
                torn = part[-1]
                yield found(rest, False)
                rest = rest.slice(rest.num_rows)
            held, rows = rest.to_batches(), weight(rest)
        if rows:
            yield from result(pa.Table.from_batches(held), torn)

    return run


def _column(c: pa.ChunkedArray) -> np.ndarray:
    return c.to_numpy()


def _binary(c: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each value begins."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    _, at, data = c.cast(pa.large_binary()).buffers()
    at = np.frombuffer(at, np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8), at[:-1] - at[0]


def _rows(bases: np.ndarray, size: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    data, at = walks.folded(bases, size)
    seq = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([seq, pa.array(size.astype(np.int32)), *(pa.array(x) for x in others)], ["seq", "n", "l", "r", "a", "b"])


def _pieces(nodes: DataFrame, k: int, bins: Bins | None = None) -> DataFrame:
    def found(t: pa.Table, whole: bool) -> pa.RecordBatch:
        word, code = _column(t.column(1)).view(np.uint64), _column(t.column(2))
        return _rows(*walks.of_block(word, code >> 6 & 3, code >> 4 & 3, code & 3, code >> 2 & 3, whole, k))

    return _dealt(nodes, k, bins).mapInArrow(_blocks(found), PIECE)


def _open(pieces: DataFrame) -> Column:
    return ((F.col("a") == walks.SHARED) | (F.col("b") == walks.SHARED)) & (F.col("n") <= LONGEST)


def _round(pieces: DataFrame, k: int, nth: int) -> DataFrame:
    """Pieces after those that meet by the smaller hash of a shared end are merged: by minimizer first, which is that of a whole block, then by a hash of its own for each round."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(1).to_numpy().astype(np.int64)
            word, _ = walks.end_words(walks.unfolded(*_binary(b.column(0)), size), size, k)
            if nth:
                x = (word + U(nth)) * U(0x9E3779B97F4A7C15)
                x = (x ^ x >> U(31)) * U(0xBF58476D1CE4E5B9)
                x ^= x >> U(29)
            else:
                x = walks.minimizers(word, k, MINIMIZER)
            part = _part(x).astype(np.int64).reshape(-1, 2)
            shared = np.stack([b.column(i).to_numpy() for i in (4, 5)], axis=1) == walks.SHARED
            part = np.where(shared, part, 1 << 40).min(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *b.columns], ["part", "seq", "n", "l", "r", "a", "b"])

    def found(t: pa.Table, whole: bool) -> pa.RecordBatch:
        size = _column(t.column(2)).astype(np.int64)
        bases = walks.unfolded(*_binary(t.column(1)), size)
        return _rows(*walks.merged(bases, size, *(_column(t.column(i)) for i in range(3, 7)), k))

    # a part that is cut costs a round
    return pieces.mapInArrow(keyed, f"part int, {PIECE}").repartition("part").sortWithinPartitions("part").mapInArrow(_blocks(found, BLOCK), PIECE)


def contracted(nodes: DataFrame, k: int, scratch: list[DataFrame], longest: int | None = None, bins: Bins | None = None) -> tuple[DataFrame, DataFrame]:
    """seq, left_ext and right_ext of the paths of nodes (words(), written or used once), each on one strand or the other, and word, l, r and cut of the nodes of those that are left over, as those of over `longest` bases are."""
    if k % 2 == 0 or k > 31:
        raise ValueError("odd k up to 31 only")
    keep = lambda df: scratch.append(written(df, "pieces")) or scratch[-1]
    now = keep(_pieces(nodes, k, bins))
    parts, was = [now.where(~_open(now))], None
    rest = now.where(_open(now))
    left = rest.count()
    for nth in range(ROUNDS):
        # what meets no other piece any more waits for one that is left over
        if not left or left == was:
            break
        now = keep(_round(rest, k, nth))
        parts.append(now.where(~_open(now)))
        rest = now.where(_open(now))
        was, left = left, rest.count()
    parts.append(rest)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    whole = (F.col("a") == walks.DEAD) & (F.col("b") == walks.DEAD)
    if longest is not None:
        whole &= F.col("n") <= longest
    return _spelled(every.where(whole)), _nodes(every.where(~whole), k)


def _spelled(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.frombuffer(b"ACGT", np.uint8)
        for b in batches:
            if b.num_rows:
                size = b.column(1).to_numpy().astype(np.int64)
                text = letters[walks.unfolded(*_binary(b.column(0)), size)]
                seq = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(text)]).cast(pa.string())
                ext = (pa.array(np.array(["A", "C", "G", "T"], object)[b.column(i).to_numpy()], pa.string()) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([seq, *ext], ["seq", "left_ext", "right_ext"])

    return pieces.mapInArrow(run, "seq string, left_ext string, right_ext string")


def _nodes(pieces: DataFrame, k: int) -> DataFrame:
    """The canonical nodes on pieces, each once, with the ends cut that nothing may follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(1).to_numpy().astype(np.int64)
            bases = walks.unfolded(*_binary(b.column(0)), size)
            at, n = np.cumsum(size) - size, size - k + 1
            first = np.cumsum(n) - n
            place = np.repeat(at - first, n) + np.arange(int(n.sum()))
            word = np.zeros(len(place), U)
            for i in range(k):
                word = word << U(2) | bases[place + i].astype(U)
            l, r = bases[np.maximum(place - 1, 0)].astype(np.int8), bases[np.minimum(place + k, len(bases) - 1)].astype(np.int8)
            last = first + n - 1
            l[first], r[last] = b.column(2).to_numpy(), b.column(3).to_numpy()
            left, right = np.zeros(len(place), np.int8), np.zeros(len(place), np.int8)
            left[first], right[last] = (b.column(i).to_numpy() == walks.DEAD for i in (4, 5))
            back = walks.turned(word, k)
            flip = back < word
            word = np.where(flip, back, word)
            l, r = np.where(flip, 3 - r, l).astype(np.int8), np.where(flip, 3 - l, r).astype(np.int8)
            cut = np.where(flip, right | left << 1, left | right << 1).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(l), pa.array(r), pa.array(cut)], ["word", "l", "r", "cut"])

    # a k-mer that two pieces share is there twice
    found = pieces.mapInArrow(run, "word long, l byte, r byte, cut byte")
    return found.groupBy("word").agg(F.first("l").alias("l"), F.first("r").alias("r"), F.bit_or("cut").alias("cut"))

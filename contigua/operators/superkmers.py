"""Extension counts over packed k-mers, one by one or in super-k-mers.

partial_counts() cuts packed k-mers out of reads; their counts are combined before the one shuffle, which suits reads in which k-mers repeat within a
task. super_kmers() cuts reads where the minimizer of their k-mers changes: a run of k-mers travels as one row, its bases and qualities packed,
to the task of its minimizer and is taken apart there. All occurrences of a canonical k-mer have one minimizer, so counts need no further exchange.

A frequent minimizer would send all its runs to one task. Minimizers with over a HOT-th of all runs, fewer than HOT in number, are counted first; their
k-mers are counted one by one, where frequent ones are combined before the shuffle. The others go as runs.

Results are those of kmers.extension_counts(). k is 64 at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import packed, windows
from contigua.operators import kmers
from contigua.operators.storage import drop_written, written

#: Bases of a minimizer, k-mers of a run at most (their flags fill one word), and the share of runs beyond which a minimizer is hot.
MINIMIZER, RUN, HOT = 9, 60, 64
#: Occurrences that a task combines at once.
COMBINED = 1 << 22


def _good(cfg: Config) -> tuple[str, str]:
    """The characters of qualities above q_min, and the others."""
    q = {chr(c): (c - cfg.quality_offset & 255 if cfg.wrap_quality else c - cfg.quality_offset) for c in range(256)}
    return "".join(c for c in q if q[c] > cfg.q_min), "".join(c for c in q if q[c] <= cfg.q_min)


def _checked_quality(cfg: Config) -> Column:
    bad = F.col("qual").rlike("[^\\x00-\\xFF]" if cfg.wrap_quality or not cfg.quality_offset else f"[^\\x{cfg.quality_offset:02X}-\\xFF]")
    return F.when(bad, F.raise_error(F.lit("a quality is below the offset or no byte"))).otherwise(F.col("qual"))


def _keys(k: int) -> list[str]:
    """The columns that tell k-mers apart."""
    return ["lo"] if k <= packed.WORD else ["hi", "lo"]


def _rows(reads: DataFrame, cfg: Config) -> tuple[DataFrame, np.ndarray]:
    """read_id, seq and qual of checked reads of k bases or more, and which bytes are good qualities."""
    packed.check(cfg.k)
    rows = kmers.checked_reads(reads, cfg).where(F.length("seq") >= cfg.k)
    return rows.select("read_id", "seq", _checked_quality(cfg).alias("qual")), windows.good_table(_good(cfg)[0])


def _arrow(*columns: tuple[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for _, c in columns], [n for n, _ in columns])


def _words(keys: list[str]) -> str:
    return ", ".join(f"{c} long" for c in keys)


def partial_counts(reads: DataFrame, cfg: Config) -> DataFrame:
    """hi where k is over 32, lo and n: the counts of kmers.extension_counts() as bytes of one word, summed over some COMBINED occurrences of a task, so a k-mer has several rows."""
    rows, ones = _rows(reads, cfg)
    k, keys = cfg.k, _keys(cfg.k)

    found = lambda b: (windows.occurrences(windows.Text.of(part.column(1), part.column(2), ones), k) for part in windows.parts(b))
    return rows.mapInArrow(_combining(found, k), f"{_words(keys)}, n long")


def _combining(found: Callable[[pa.RecordBatch], Iterable[tuple]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of partial_counts() of the occurrences that `found` makes of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def result() -> Iterator[pa.RecordBatch]:
            if held:
                hi, lo, l, r = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
                hi, lo, n = windows.counted(hi, lo, l, r, k)
                yield _arrow(*((c, x) for c, x in (("hi", hi), ("lo", lo)) if x is not None), ("n", n))

        size = 0
        for b in batches:
            for part in found(b):
                held.append(part)
                size += len(part[1])
                if size >= COMBINED:
                    yield from result()
                    held.clear()
                    size = 0
        yield from result()

    return run


def summed(rows: DataFrame, cfg: Config, least: int | None = None, dealt: bool = False, unique: bool = False) -> DataFrame:
    """The sums of rows of partial_counts(), spelled: kmer and kmers.COUNTS; with `least`, kmer, lmask and rmask of ufx.masks() instead, without k-mers that have neither;
    with `unique`, too, word, l and r (0 to 3) of the k-mers with one valid base on each side, 32 bases at most.

    Words are dealt, unless they are `dealt` so that each k-mer is in one task, and sorted by k-mer, so a task holds a batch of them, however many k-mers it gets.
    """
    k, keys = cfg.k, _keys(cfg.k)
    bit = np.array([1, 2, 4, 8])
    code = np.full(16, -1, np.int8)
    code[bit] = range(4)

    def row(key: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        if least is None:
            return _arrow(("kmer", windows.spelled(key[0], key[-1], k)), *((c, np.ascontiguousarray(n[:, i])) for i, c in enumerate(kmers.COUNTS)))
        l, r = ((n[:, side] >= least) @ bit for side in (slice(0, 4), slice(4, 8)))
        if unique:
            some = (code[l] >= 0) & (code[r] >= 0)
            return _arrow(("word", key[-1][some]), ("l", code[l[some]]), ("r", code[r[some]]))
        some = (l | r) > 0
        key = [x[some] for x in key]
        return _arrow(("kmer", windows.spelled(key[0], key[-1], k)), ("lmask", l[some].astype(np.int8)), ("rmask", r[some].astype(np.int8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last k-mer of a batch may go on in the next one
        last: tuple[list[np.ndarray], np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            *key, n = (b.column(i).to_numpy() for i in range(b.num_columns))
            at = windows.first_of_runs(*key)
            key, n = [x[at].view(np.uint64) for x in key], windows.sums(n, at)
            if last is not None:
                if all(x[0] == y[0] for x, y in zip(key, last[0], strict=True)):
                    n[0] += last[1][0]
                else:
                    yield row(*last)
            yield row([x[:-1] for x in key], n[:-1])
            last = [x[-1:] for x in key], n[-1:]
        if last is not None:
            yield row(*last)

    out = "kmer string, " + (", ".join(f"{c} long" for c in kmers.COUNTS) if least is None else "lmask byte, rmask byte")
    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys).mapInArrow(run, "word long, l byte, r byte" if unique else out)


def extension_counts(reads: DataFrame, cfg: Config) -> DataFrame:
    """kmers.extension_counts() by packed keys: combined in each task, then one exchange of 16 bytes a row, or 24 over 32 bases."""
    return summed(partial_counts(reads, cfg), cfg)


def valid_masks(reads: DataFrame, cfg: Config) -> DataFrame:
    """kmer, lmask and rmask of the k-mers with a valid base on either side."""
    return summed(partial_counts(reads, cfg), cfg, cfg.d_min)


def unique_words(reads: DataFrame, cfg: Config) -> DataFrame:
    """word, l and r of the k-mers, 32 bases at most, with one valid base on each side: what contigs are made of, as contigs.dealt_words() takes it."""
    if cfg.k > packed.WORD:
        raise ValueError(f"k-mers of a word have {packed.WORD} bases at most")
    return summed(partial_counts(reads, cfg), cfg, cfg.d_min, unique=True)


def good_words(reads: DataFrame, cfg: Config) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray | None, np.ndarray]]]]:
    """Checked reads, and a function that cuts a batch of them into hi and lo of the canonical k-mers with a good neighbour, part by part."""
    rows, ones = _rows(reads, cfg)
    k = cfg.k
    return rows, lambda b: (windows.good_places(windows.Text.of(part.column(1), part.column(2), ones), k)[1:] for part in windows.parts(b))


def distinct_kmers(reads: DataFrame, cfg: Config) -> DataFrame:
    """kmer, spelled, and its words, hi where k is over 32 and lo, of the canonical k-mers that occur with a good neighbour, each once.

    Tasks combine some COMBINED occurrences; their words are exchanged once, sorted, and only those that are left are spelled.
    """
    rows, cut = good_words(reads, cfg)
    k, keys = cfg.k, _keys(cfg.k)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def result() -> Iterator[pa.RecordBatch]:
            if held:
                hi, lo = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
                if hi is None:
                    lo.sort()
                else:
                    order = np.lexsort((lo, hi))
                    hi, lo = hi[order], lo[order]
                words = [x for x in (hi, lo) if x is not None]
                at = windows.first_of_runs(*words)
                yield _arrow(*((c, x[at]) for c, x in zip(keys, words, strict=True)))

        size = 0
        for b in batches:
            for hi, lo in cut(b):
                held.append((hi, lo))
                size += len(lo)
                if size >= COMBINED:
                    yield from result()
                    held.clear()
                    size = 0
        yield from result()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = [c.to_numpy().view(np.uint64) for c in b.columns]
            at = windows.first_of_runs(*key)
            # the last k-mer of a batch may be the first one of the next
            if last is not None and all(x[0] == y for x, y in zip(key, last, strict=True)):
                at = at[1:]
            last = [x[-1] for x in key]
            key = [x[at] for x in key]
            yield _arrow(("kmer", windows.spelled(key[0], key[-1], k)), *zip(keys, key, strict=True))

    words = rows.mapInArrow(found, _words(keys))
    return words.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(once, f"kmer string, {_words(keys)}")


def kmer_sets(reads: DataFrame, k: int, of: Column) -> DataFrame:
    """kmer, a word, and sets of all k-mers without N, up to 32 bases, each once: bit i of sets is set if reads whose number `of` (0 to 6) is i have it.

    Tasks combine some COMBINED occurrences; their rows are exchanged once.
    """
    if not 0 < k <= packed.WORD:
        raise ValueError(f"k-mers of a word have 1 to {packed.WORD} bases")
    rows = kmers.checked_reads(reads, Config(k=k)).where(F.length("seq") >= k).select(of.cast("byte").alias("of"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def result() -> Iterator[pa.RecordBatch]:
            if held:
                word, sets = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(word)
                word, sets = word[order], sets[order]
                at = windows.first_of_runs(word)
                if len(at):
                    yield _arrow(("kmer", word[at]), ("sets", np.bitwise_or.reduceat(sets, at)))

        size = 0
        for b in batches:
            for part in windows.parts(b):
                at, word = windows.words(part.column(1), k)
                length = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                bit = np.repeat(np.int8(1) << part.column(0).to_numpy(), length)[at - 1]
                held.append((word, bit))
                size += len(word)
                if size >= COMBINED:
                    yield from result()
                    held.clear()
                    size = 0
        yield from result()

    return rows.mapInArrow(run, "kmer long, sets byte").repartition("kmer").groupBy("kmer").agg(F.bit_or("sets").alias("sets"))


def _by_kmer(hi: np.ndarray | None, lo: np.ndarray, read: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of occurrences by k-mer, read and place, and which of them, so sorted, are the first of their k-mer."""
    if hi is None:
        # reads mostly come in order
        in_order = ((read[1:] > read[:-1]) | (read[1:] == read[:-1]) & (pos[1:] >= pos[:-1])).all()
        by = None if in_order else np.lexsort((pos, read))
        order = windows.order(lo if by is None else lo[by], 2 * k)
        order = order if by is None else by[order]
    else:
        order = np.lexsort((pos, read, lo, hi))
    first = np.zeros(len(lo), bool)
    first[windows.first_of_runs(*(x[order] for x in (hi, lo) if x is not None))] = True
    return order, first


def without_first(reads: DataFrame, cfg: Config, may_repeat: Callable[[np.ndarray | None, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """kmers.without_first() of the good occurrences of canonical k-mers of reads with whole numbers as read_id: read_id, pos and kmer.

    Of the COMBINED occurrences that a task holds at once only the first one of each k-mer can be the first of all. So the others are let through as they are found, and
    these first ones alone are exchanged, as words, to find which of them others precede. reads are read for each part and so must be the same both times.
    may_repeat tells, for hi and lo of some k-mers, which are not single for sure; the others leave as they are found.
    """
    rows, ones = _rows(reads, cfg)
    k, keys = cfg.k, _keys(cfg.k)
    kind = reads.schema["read_id"].dataType.simpleString()
    rows = rows.withColumn("read_id", F.col("read_id").cast("long"))

    def found(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def result() -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                hi, lo, read, pos = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
                order, is_first = _by_kmer(hi, lo, read, pos, k)
                order = order[is_first == first]
                hi, lo, read, pos = (x if x is None else x[order] for x in (hi, lo, read, pos))
                if first:
                    yield _arrow(*((c, x) for c, x in (("hi", hi), ("lo", lo)) if x is not None), ("read_id", read), ("pos", pos))
                else:
                    yield _arrow(("read_id", read), ("pos", pos), ("kmer", windows.spelled(hi, lo, k)))

            size = 0
            for b in batches:
                for part in windows.parts(b):
                    at, hi, lo = windows.good_places(windows.Text.of(part.column(1), part.column(2), ones), k)
                    if may_repeat is not None:
                        some = may_repeat(hi, lo)
                        at, hi, lo = (x if x is None else x[some] for x in (at, hi, lo))
                    begin = np.cumsum(np.r_[1, pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False)[:-1].astype(np.int64) + 1])
                    of = np.searchsorted(begin, at, "right") - 1
                    held.append((hi, lo, part.column(0).to_numpy()[of], (at - begin[of]).astype(np.int32)))
                    size += len(lo)
                    if size >= COMBINED:
                        yield from result()
                        held.clear()
                        size = 0
            yield from result()

        return run

    def preceded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            *key, read, pos = (c.to_numpy() for c in b.columns)
            key = [x.view(np.uint64) for x in key]
            same = np.ones(len(read), bool)
            same[windows.first_of_runs(*key)] = False
            same[0] = last is not None and all(x[0] == y for x, y in zip(key, last, strict=True))
            last = [x[-1] for x in key]
            yield _arrow(("read_id", read[same]), ("pos", pos[same]), ("kmer", windows.spelled(key[0][same] if len(key) > 1 else None, key[-1][same], k)))

    out = "read_id long, pos int, kmer string"
    others = rows.mapInArrow(found(False), out)
    firsts = rows.mapInArrow(found(True), f"{_words(keys)}, read_id long, pos int").repartition(*keys).sortWithinPartitions(*keys, "read_id", "pos").mapInArrow(preceded, out)
    return others.unionAll(firsts).withColumn("read_id", F.col("read_id").cast(kind))


def super_kmers(reads: DataFrame, cfg: Config, size: int = MINIMIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """bin (the minimizer's hash), n (k-mers of the run), p (pieces of the base before, the run and the base after), a and b (flags of n good neighbours left and right).

    The minimizer of a k-mer is the smallest hash of its parts of `size` bases on either strand, so both strands of a k-mer have the same.
    keep: read_id and s, the place of the run's first k-mer, where they are wanted.
    """
    size = min(size, cfg.k, packed.WORD)
    rows, ones = _rows(reads, cfg)
    k = cfg.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in windows.parts(b):
                at, n, least, begin, words, left, right = windows.runs(windows.Text.of(part.column(1), part.column(2), ones), k, size, RUN)
                first = np.cumsum(np.r_[1, pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False)[:-1] + 1])
                of = np.searchsorted(first, at, "right") - 1
                own = {"read_id": lambda: part.column(0).take(pa.array(of)), "s": lambda: pa.array((at - first[of]).astype(np.int32))}
                pieces = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(words.view(np.int64)))
                yield _arrow(*((c, own[c]()) for c in keep), ("bin", least), ("n", n.astype(np.int8)), ("p", pieces), ("a", left), ("b", right))

    kinds = {"read_id": reads.schema["read_id"].dataType.simpleString(), "s": "int"}
    return rows.mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in keep) + "bin long, n byte, p array<long>, a long, b long")


def _apart(runs: DataFrame, cfg: Config) -> DataFrame:
    """Rows of partial_counts() of the k-mers of runs."""
    k, keys = cfg.k, _keys(cfg.k)

    def found(b: pa.RecordBatch) -> Iterator[tuple]:
        if b.num_rows:
            n, p, left, right = b.columns
            size = np.r_[0, np.cumsum(pc.list_value_length(p).to_numpy(zero_copy_only=False))].astype(np.int64)
            yield windows.apart(n.to_numpy().astype(np.int64), size[:-1], *(x.to_numpy().view(np.uint64) for x in (p.flatten(), left, right)), k)

    return runs.select("n", "p", "a", "b").mapInArrow(_combining(found, k), f"{_words(keys)}, n long")


def hot_bins(runs: DataFrame, share: int = HOT) -> list[int]:
    """Minimizers with over a share-th of all runs: fewer than `share`."""
    each = written(runs.groupBy("bin").agg(F.count("*").alias("n")), "bins")
    most = each.agg(F.sum("n")).first()[0] or 0
    found = [r["bin"] for r in each.where(F.col("n") * share > most).select("bin").collect()]
    drop_written(each)
    return found


def extension_counts_by_runs(reads: DataFrame, cfg: Config, size: int = MINIMIZER, share: int = HOT) -> DataFrame:
    """kmers.extension_counts() with an exchange of super-k-mers."""
    # written, as minimizers are the dear part and runs are read twice
    runs = written(super_kmers(reads, cfg, size), "runs")
    hot = hot_bins(runs, share)
    # all k-mers of a minimizer are in its task
    cold = summed(_apart((runs.where(~F.col("bin").isin(hot)) if hot else runs).repartition("bin"), cfg), cfg, dealt=True)
    return cold.unionByName(summed(_apart(runs.where(F.col("bin").isin(hot)), cfg), cfg)) if hot else cold

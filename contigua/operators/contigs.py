"""The k-mer graph and its maximal unbranched paths.

Nodes are the oriented k-mers with one valid base on each side, in both orientations. An edge leads from u to v if v is u moved
on by its right base and v's left base is u's first one. Each node has one predecessor and one successor at most, so the graph
falls into paths and cycles.

Neighbours mostly share a minimizer, so nodes are dealt by it and each task walks the paths that it holds, block by block, into pieces.
Pointer doubling then labels the pieces in as many rounds as the longest path has binary digits: each round joins those that are not
settled with the pointers they hold and writes the result to the shared folder. Plans and size estimates therefore stay small, and
a lost executor costs one round. How nodes are dealt and cut into blocks changes the pieces, not the paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import dna, walks
from contigua.operators import compaction, kmers, superkmers, ufx
from contigua.operators.storage import drop_written, written


def oriented_nodes(table: DataFrame) -> DataFrame:
    """u, l, r: the k-mers that are unique on both sides, in both orientations."""
    lettered = ufx.unique_both(table).select("kmer", ufx.unique_base("lmask").alias("lext"), ufx.unique_base("rmask").alias("rext"))
    return ufx.both_strands(lettered).select(F.col("kmer").alias("u"), F.col("lext").alias("l"), F.col("rext").alias("r"))


def following(u: Column | str, r: Column | str) -> Column:
    """The k-mer that comes after u by the base r."""
    c = F.col(u) if isinstance(u, str) else u
    return F.concat(F.substr(c, F.lit(2)), F.col(r) if isinstance(r, str) else r)


def _ahead(nodes: DataFrame) -> DataFrame:
    """The k + 1 bases that each node and its right base make."""
    return nodes.select(F.concat("u", "r").alias("step"))


def _back(nodes: DataFrame) -> DataFrame:
    """The k + 1 bases that each node's left base and it make."""
    return nodes.select(F.concat("l", "u").alias("step"))


# the node that a step leads from and that which it leads to: a step tells both, so nothing else is exchanged
_from = lambda: F.expr("substring(step, 1, length(step) - 1)")
_to = lambda: F.expr("substring(step, 2)")


def edges(nodes: DataFrame) -> DataFrame:
    """u, v where both ends agree: the k + 1 bases that one makes ahead are those that the other makes back; a step has one node at either end."""
    return _ahead(nodes).join(_back(nodes), "step", "left_semi").select(_from().alias("u"), _to().alias("v"))


def path_heads(nodes: DataFrame) -> DataFrame:
    """u of the nodes that nothing leads to: one anti-join, no edge is made for it."""
    return _back(nodes).join(_ahead(nodes), "step", "left_anti").select(_to().alias("u"))


def path_tails(nodes: DataFrame) -> DataFrame:
    """u of the nodes that lead nowhere."""
    return _ahead(nodes).join(_back(nodes), "step", "left_anti").select(_from().alias("u"))


def numbered_nodes(oriented: DataFrame) -> DataFrame:
    """Oriented nodes with an id each, written, so that ids stand; rounds join on ids, which are shorter than k-mers."""
    return written(oriented.withColumn("id", F.monotonically_increasing_id()), "nodes")


def edge_ids(nodes: DataFrame) -> DataFrame:
    """u, v: the edges as ids."""
    rows = nodes.select(F.col("u").alias("k"), "id", "l", "r")
    ahead = rows.select(F.col("id").alias("u"), F.concat("k", "r").alias("step"))
    back = rows.select(F.col("id").alias("v"), F.concat("l", "k").alias("step"))
    return ahead.join(back, "step").select("u", "v")


def _doubled(nodes: DataFrame, links: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(u, head, d) of the nodes (column u) on paths, and u of those on cycles.

    In a round each node that is not settled asks the one that it points to, 2**round steps back. A settled node that nobody asks in
    a round is never asked again: a later asker stands further on, and the node between would have asked. So a round reads
    the answers of the last one only, and the tables shrink as paths settle.
    """
    before = links.select(F.col("v").alias("u"), F.col("u").alias("before"))
    first = nodes.select("u").join(before, "u", "left").select("u", F.coalesce("before", "u").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("d"), F.col("before").isNull().alias("done"))
    now = written(first, "paths")
    scratch.append(now)
    parts, pool = [now.where("done")], now
    rest, was = now.where("not done"), None
    left = rest.count()
    # a round settles part of each path that has nodes left; where none settles, only cycles are left
    while left and left != was:
        asking = rest.select(F.col("u").alias("asker"), F.col("head").alias("u"), F.col("d").alias("more"))
        answers = written(pool.join(asking, "u").select("asker", F.col("d") + F.col("more"), "u", "head", "d", "done").toDF("asker", "far", "u", "head", "d", "done"), "paths")
        scratch.append(answers)
        now = answers.select(F.col("asker").alias("u"), "head", F.col("far").alias("d"), "done")
        parts.append(now.where("done"))
        pool = now.unionAll(answers.where("done").select("u", "head", "d", "done"))
        rest, was = now.where("not done"), left
        left = rest.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("u", "head", "d"), rest.select("u")


def _starts(cycles: DataFrame, links: DataFrame, kmers_of: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """u of the node of each cycle that is the smallest canonical k-mer on it; a cycle without it, a mirror image, has none."""
    now = written(cycles.join(kmers_of, "u").join(links, "u").select("u", F.col("v").alias("to"), dna.canonical("kmer").alias("least"), "kmer"), "cycles")
    scratch.append(now)
    n, reach = now.count(), 1
    while reach < n:
        to = now.select(F.col("u").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        now = written(now.join(to, "to").select("u", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), "kmer"), "cycles")
        scratch.append(now)
        reach *= 2
    return now.where("kmer = least").select("u")


def labelled(nodes: DataFrame, links: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """u, head, d, cyclic, as ids: the first node of each node's path and the steps from it; nodes: id and the k-mer u.

    A cycle starts at the smallest canonical k-mer on it; its mirror image, which does not hold that k-mer as it is, goes.
    """
    settled, cycles = _doubled(nodes.select(F.col("id").alias("u")), links, scratch)
    out = settled.withColumn("cyclic", F.lit(False))
    if cycles.isEmpty():
        return out
    start = _starts(cycles, links, nodes.select(F.col("id").alias("u"), F.col("u").alias("kmer")), scratch)
    opened = written(links.join(cycles, "u").join(start.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"), "cycles")
    scratch.append(opened)
    again, _ = _doubled(cycles, opened, scratch)
    return out.unionAll(again.join(start.select(F.col("u").alias("head")), "head", "left_semi").select("u", "head", "d", F.lit(True).alias("cyclic")))


#: log2 of the steps whose bases are joined at once.
CHUNK_BITS = 12


def _in_order(place: str, part: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, part))), lambda s: s[part]), "")


def joined(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """seq, left_ext, right_ext of each path, in the orientation that was walked.

    Bases are joined in chunks of steps first and chunks then, so that only the sequence itself is as long as its path.
    """
    rows = labels.select(F.col("u").alias("id"), "head", "d", "cyclic").join(nodes, "id").withColumn("chunk", F.shiftright("d", CHUNK_BITS))
    ends = F.min(F.struct("d", "u", "l", "r")).alias("first"), F.max(F.struct("d", "r")).alias("last"), F.bool_or("cyclic").alias("cyclic")
    chunks = rows.withColumn("part", F.right("u", F.lit(1))).groupBy("head", "chunk").agg(_in_order("d", "part").alias("part"), *ends)
    paths = chunks.groupBy("head").agg(_in_order("chunk", "part").alias("tail"), F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("cyclic").alias("cyclic"))
    # a cycle ends with the node it began with
    tail = F.when(F.col("cyclic"), F.concat("tail", F.right("first.u", F.lit(1)))).otherwise(F.col("tail"))
    seq = F.concat(F.expr("substring(first.u, 1, length(first.u) - 1)"), tail)
    return paths.select(seq.alias("seq"), F.col("first.l").alias("left_ext"), F.when(F.col("cyclic"), F.col("first.r")).otherwise(F.col("last.r")).alias("right_ext"))


def reverse_contigs(contigs: DataFrame) -> DataFrame:
    """Each contig read from the other strand, its extensions swapped and paired."""
    return contigs.select(dna.revcomp("seq").alias("seq"), dna.complement("right_ext").alias("left_ext"), dna.complement("left_ext").alias("right_ext"))


def on_one_strand(walked: DataFrame) -> DataFrame:
    """seq, left_ext, right_ext, len: each on its smaller strand."""
    rows = walked.withColumn("_rc", dna.revcomp("seq")).withColumn("_flip", F.col("_rc") < F.col("seq"))
    pick = lambda yes, no: F.when(F.col("_flip"), yes).otherwise(no)
    rows = rows.select(F.least("seq", "_rc").alias("seq"), pick(dna.complement("right_ext"), F.col("left_ext")).alias("left_ext"), pick(dna.complement("left_ext"), F.col("right_ext")).alias("right_ext"))
    return rows.withColumn("len", F.length("seq").cast("long"))


def one_strand(walked: DataFrame) -> DataFrame:
    """One of each pair of strands, as on_one_strand()."""
    return on_one_strand(walked).groupBy("seq").agg(F.min(F.struct("left_ext", "right_ext")).alias("e")).select("seq", "e.left_ext", "e.right_ext", F.length("seq").cast("long").alias("len"))


#: Bases of a minimizer, and nodes that a task walks at once.
MINIMIZER, BLOCK = 7, 1 << 18


def minimizer(u: Column | str) -> Column:
    """The smallest hash of MINIMIZER bases in a row: that of the next k-mer is mostly the same."""
    c = F.col(u) if isinstance(u, str) else u
    size = F.least(F.lit(MINIMIZER), F.length(c))
    return F.array_min(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.xxhash64(F.substr(c, i, size))))


def walked(u: list[str], left: list[str], right: list[str]) -> Iterator[tuple[str, str, str]]:
    """seq, left_ext and right_ext of the paths among some nodes; a cycle is cut anywhere."""
    ahead = {b + k: i for i, (k, b) in enumerate(zip(u, left, strict=True))}
    following = [ahead.get(k + b, -1) for k, b in zip(u, right, strict=True)]
    inner, seen = set(following), bytearray(len(u))
    heads = [i for i in range(len(u)) if i not in inner]
    for start in (*heads, *range(len(u))):
        if seen[start]:
            continue
        i, bases = start, [u[start]]
        seen[i] = 1
        while (n := following[i]) >= 0 and not seen[n]:
            i = n
            seen[i] = 1
            bases.append(u[i][-1])
        yield "".join(bases), left[start], right[i]


def dealt_by_bin(nodes: DataFrame, part_of: Column, block: int) -> DataFrame:
    """nodes with bin, each bin in one task, or dealt to several by the hash part_of where it has more than `block` nodes."""
    large = written(nodes.groupBy("bin").agg(F.count("*").alias("_n")).where(F.col("_n") > block), "bins")
    if large.isEmpty():
        drop_written(large)
        return nodes.repartition("bin").sortWithinPartitions("bin")
    part = F.coalesce(F.pmod(F.xxhash64(part_of), F.ceil(F.col("_n") / block)), F.lit(0))
    return nodes.join(large, "bin", "left").withColumn("part", part).drop("_n").repartition("bin", "part").sortWithinPartitions("bin", "part")


def pieces(nodes: DataFrame, bin_of: Column) -> DataFrame:
    """id, seq, l, r, into and out: paths of nodes (u, l, r) that meet in a block, with the k + 1 bases of the steps into and out of each.

    Nodes are dealt by bin_of; a block holds whole bins where these are not larger than it. Larger ones are dealt to as many tasks as they fill blocks, by
    the minimizer, so that tasks grow with the nodes, not with the number of bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result() -> Iterator[pa.RecordBatch]:
            u, left, right = ([x for b in held for x in b.column(i).to_pylist()] for i in range(3))
            if u:
                k = len(u[0])
                seq, first, last = zip(*walked(u, left, right), strict=True)
                columns = (seq, first, last, [b + s[:k] for s, b in zip(seq, first, strict=True)], [s[-k:] + b for s, b in zip(seq, last, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["seq", "l", "r", "into", "out"])

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield from result()
                held.clear()
                rows = 0
        yield from result()

    dealt = dealt_by_bin(nodes.withColumn("least", dna.canonical("u")).withColumn("bin", bin_of), minimizer("u"), BLOCK).select("u", "l", "r")
    return dealt.mapInArrow(run, "seq string, l string, r string, into string, out string").withColumn("id", F.monotonically_increasing_id())


def _letters(codes: np.ndarray) -> pa.Array:
    return pa.array(np.array(["A", "C", "G", "T"], object)[codes], pa.string())


def dealt_words(table: DataFrame, k: int, bin_of: Column | None) -> DataFrame:
    """word, l and r of the k-mers that are unique on both sides, each once, dealt by their minimizer; with bin_of by that where a bin has BLOCK nodes at most.

    table: kmer, lmask and rmask, or rows of superkmers.unique_words(), which have no bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(16, np.int8)
        code[[1, 2, 4, 8]] = range(4)
        for b in batches:
            if not b.num_rows:
                continue
            text = np.frombuffer("".join(b.column(0).to_pylist()).encode(), np.uint8).reshape(-1, k)
            word = walks.packed(text, k)
            part = walks.minimizers(word, k, MINIMIZER).view(np.int64)
            small = b.column(3).to_numpy(zero_copy_only=False)
            # with nulls these are floats, exact ones as they have 32 bits
            part = np.where(np.isnan(small), part, np.nan_to_num(small).astype(np.int64)) if small.dtype.kind == "f" else small.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(word.view(np.int64)), *(pa.array(code[b.column(i).to_numpy()]) for i in (1, 2))], ["part", "word", "l", "r"])

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = walks.minimizers(b.column(0).to_numpy().view(np.uint64), k, MINIMIZER).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), *b.columns], ["part", "word", "l", "r"])

    if "word" in table.columns:
        return table.select("word", "l", "r").mapInArrow(with_part, "part long, word long, l byte, r byte").repartition("part").sortWithinPartitions("part").select("word", "l", "r")
    rows = ufx.unique_both(table).select("kmer", "lmask", "rmask")
    small = F.lit(None).cast("long")
    if bin_of is not None:
        binned = rows.withColumn("least", F.col("kmer")).withColumn("u", F.col("kmer")).withColumn("bin", bin_of)
        # a bin that fills more than a block would be cut where neighbours part; its nodes are dealt by minimizer, with those of other such bins
        few = binned.groupBy("bin").agg(F.count("*").alias("_n")).where(F.col("_n") <= BLOCK).select("bin", F.crc32(F.col("bin").cast("string").cast("binary")).alias("small"))
        rows, small = binned.join(few, "bin", "left"), F.col("small")
    rows = rows.select("kmer", "lmask", "rmask", small.alias("small"))
    return rows.mapInArrow(run, "part long, word long, l byte, r byte").repartition("part").sortWithinPartitions("part").select("word", "l", "r")


def blocks(found: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `found` makes of the word, l and r of the nodes of each block of dealt_words()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def result() -> Iterator[pa.RecordBatch]:
            if held:
                word, l, r = (np.concatenate(x) for x in zip(*held, strict=True))
                if len(word):
                    yield found(word.view(np.uint64), l, r)

        rows = 0
        for b in batches:
            held.append(tuple(c.to_numpy() for c in b.columns))
            rows += b.num_rows
            if rows >= BLOCK:
                yield from result()
                held.clear()
                rows = 0
        yield from result()

    return run


def block_paths(word: np.ndarray, l: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """places and begin of walks.walked(), with the nodes on circles: one node of each is a path of its own, what is left of the circle another."""
    places, begin, circles = walks.walked(word, l, r, k)
    if len(circles):
        first, rest = walks.circle_starts(word, l, r, k, circles)
        lone = np.stack([2 * first, 2 * first + 1], axis=1).ravel()
        more, at, _ = walks.walked(word[rest], l[rest], r[rest], k) if len(rest) else (rest, rest, rest)
        more = 2 * rest[more >> 1] + (more & 1) if len(rest) else more
        places, begin = np.concatenate([places, lone, more]), np.concatenate([begin, len(places) + np.arange(len(lone)), len(places) + len(lone) + at])
    return places, begin


def word_pieces(table: DataFrame, k: int, bin_of: Column | None = None) -> DataFrame:
    """pieces() for odd k up to 31: into and out are words, and pieces 2 i and 2 i + 1 are the two strands of one."""

    def found(word: np.ndarray, l: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        places, begin = block_paths(word, l, r, k)
        text, at, left, right, into, out = walks.sequences(places, begin, word, l, r, k)
        seq = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(text)]).cast(pa.string())
        return pa.RecordBatch.from_arrays([seq, _letters(left), _letters(right), pa.array(into.view(np.int64)), pa.array(out.view(np.int64))], ["seq", "l", "r", "into", "out"])

    return dealt_words(table, k, bin_of).mapInArrow(blocks(found), "seq string, l string, r string, into long, out long").withColumn("id", F.monotonically_increasing_id())


def _one_of_each(labels: DataFrame) -> DataFrame:
    """labels of one of each path of word_pieces() and its mirror image, which begins with the other strand of its last piece."""
    ends = labels.groupBy("head").agg(F.max(F.struct("d", "u")).alias("e")).where(F.col("head") <= F.col("e.u").bitwiseXOR(F.lit(1).cast("long")))
    return labels.join(ends.select("head"), "head", "left_semi")


def joined_pieces(found: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """seq, left_ext and right_ext of the paths of pieces, in chunks of pieces as joined() has them of steps."""
    rows = labels.select(F.col("u").alias("id"), "head", "d").join(found, "id")
    rows = rows.withColumn("part", F.when(F.col("d") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(k)))).withColumn("chunk", F.shiftright("d", CHUNK_BITS))
    ends = F.min(F.struct("d", "l")).alias("first"), F.max(F.struct("d", "r")).alias("last")
    chunks = rows.groupBy("head", "chunk").agg(_in_order("d", "part").alias("part"), *ends)
    paths = chunks.groupBy("head").agg(_in_order("chunk", "part").alias("seq"), F.min("first").alias("first"), F.max("last").alias("last"))
    return paths.select("seq", F.col("first.l").alias("left_ext"), F.col("last.r").alias("right_ext"))


def kmer_length(table: DataFrame) -> int:
    """k of a UFX table; 1 where it is empty."""
    some = table.select("kmer").head()
    return len(some[0]) if some else 1


def of_reads(reads: DataFrame, cfg: Config) -> DataFrame:
    """contigs() of the UFX table of reads; of odd k up to 31 its k-mers stay words and are not written."""
    if cfg.k % 2 == 1 and cfg.k <= 31:
        return contigs(superkmers.unique_words(reads, cfg), k=cfg.k)
    return contigs(written(ufx.ufx_table(reads, cfg), "ufx"))


def contigs(table: DataFrame, bin_of: Column | None = None, k: int | None = None) -> DataFrame:
    """seq, left_ext, right_ext, len of the maximal unbranched paths of a UFX table (kmer, lmask, rmask), or of superkmers.unique_words() of odd k up to 31.

    bin_of, an expression over the k-mer u or its canonical form least, tells which nodes are walked together first; the result does not depend on it.
    """
    k = kmer_length(table) if k is None else k
    if k % 2 == 1 and k <= 31 and bin_of is None:
        return _contracted(compaction.words(table, k), k, lambda rest: contigs_of_pieces(rest, None, k))
    return contigs_of_pieces(table, bin_of, k)


def _contracted(nodes: DataFrame, k: int, of_rest: Callable[[DataFrame], DataFrame], bins: compaction.Bins | None = None) -> DataFrame:
    """seq, left_ext, right_ext, len of the paths of compaction.words(); of_rest takes what is left over, as rows of superkmers.unique_words()."""
    scratch: list[DataFrame] = []
    walks_, rest = compaction.contracted(nodes, k, scratch, bins=bins)
    out = on_one_strand(walks_)
    rest = written(rest, "nodes")
    if not rest.isEmpty():
        out = out.unionAll(of_rest(rest))
    out = written(out, "contigs")
    discard(rest, *scratch)
    return out


def contigs_of_pieces(table: DataFrame, bin_of: Column | None, k: int) -> DataFrame:
    """contigs() by pointer doubling over pieces."""
    scratch: list[DataFrame] = []
    keep = lambda df, what: scratch.append(written(df, what)) or scratch[-1]
    words = k % 2 == 1 and k <= 31
    found = keep(word_pieces(table, k, bin_of) if words else pieces(oriented_nodes(table), minimizer("u") if bin_of is None else bin_of), "pieces")
    steps = found.select(F.col("id").alias("u"), F.col("out").alias("step")).join(found.select(F.col("id").alias("v"), F.col("into").alias("step")), "step")
    labels, cycles = _doubled(found.select(F.col("id").alias("u")), keep(steps.select("u", "v"), "edges"), scratch)
    walks_ = joined_pieces(found, _one_of_each(keep(labels, "labels")) if words else labels, k)
    if not cycles.isEmpty():
        # what lies on a cycle is labelled node by node, from its smallest canonical k-mer on
        on = found.join(cycles.select(F.col("u").alias("id")), "id", "left_semi").select("seq", "l", "r", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("i"))
        base = lambda at: F.substr("seq", at, F.lit(1))
        left, right = F.when(F.col("i") == 1, F.col("l")).otherwise(base(F.col("i") - 1)), F.when(F.col("i") == F.length("seq") - k + 1, F.col("r")).otherwise(base(F.col("i") + k))
        circle = keep(on.select(F.substr("seq", F.col("i"), F.lit(k)).alias("u"), left.alias("l"), right.alias("r")).withColumn("id", F.monotonically_increasing_id()), "nodes")
        walks_ = walks_.unionAll(joined(circle, labelled(circle, keep(edge_ids(circle), "edges"), scratch)))
    out = written(on_one_strand(walks_) if words else one_strand(walks_), "contigs")
    discard(*scratch)
    return out


def _binned_edges(nodes: DataFrame, links: DataFrame, bin_of: Column, bins: int) -> DataFrame:
    """u, v and inside: whether the canonical k-mers of both ends are of one bin."""
    binned = lambda c: nodes.select(F.col("id").alias(c), dna.canonical("u").alias("least")).select(c, F.pmod(bin_of, F.lit(bins)).alias(f"{c}_bin"))
    return links.join(binned("u"), "u").join(binned("v"), "v").select("u", "v", (F.col("u_bin") == F.col("v_bin")).alias("inside"))


def local_contigs(table: DataFrame, bin_of: Column, bins: int, k: int | None = None) -> DataFrame:
    """seq, left_ext, right_ext, len of the paths within bins of canonical k-mers, before two_level() joins them; cycles within a bin are none.

    With odd k up to 31 nodes tell by themselves where the next one is of another bin, and only what is left over is joined node by node.
    """
    k = kmer_length(table) if k is None else k
    if k % 2 == 1 and k <= 31:
        part = F.pmod(bin_of, F.lit(bins))
        return _contracted(compaction.within_bins(table, k, part), k, lambda rest: _local_by_nodes(spelled_nodes(rest, k), bin_of, bins))
    return _local_by_nodes(oriented_nodes(table), bin_of, bins)


def spelled_nodes(words: DataFrame, k: int) -> DataFrame:
    """oriented_nodes() of rows of superkmers.unique_words()."""
    base = lambda code: F.substr(F.lit(dna.BASES), F.lit(1) + code, F.lit(1))
    kmer = F.concat(*(base(F.shiftright("word", 2 * i).bitwiseAND(F.lit(3)).cast("int")) for i in reversed(range(k))))
    return ufx.both_strands(words.select(kmer.alias("kmer"), base(F.col("l").cast("int")).alias("lext"), base(F.col("r").cast("int")).alias("rext"))).select(
        F.col("kmer").alias("u"), F.col("lext").alias("l"), F.col("rext").alias("r")
    )


def _local_by_nodes(found: DataFrame, bin_of: Column, bins: int) -> DataFrame:
    nodes = numbered_nodes(found)
    links = written(edge_ids(nodes), "edges")
    scratch = [nodes, links]
    inside = _binned_edges(nodes, links, bin_of, bins).where("inside").select("u", "v")
    paths, _ = _doubled(nodes.select(F.col("id").alias("u")), inside, scratch)
    out = written(one_strand(joined(nodes, paths.withColumn("cyclic", F.lit(False)))), "contigs")
    discard(*scratch)
    return out


def two_level(table: DataFrame, bin_of: Column, bins: int) -> DataFrame:
    """Like contigs(), with given bins: paths within bins of canonical k-mers first, then the ends of these across bins.

    bin_of is an expression over the column least, the canonical k-mer. The second step works on one row for each local path.
    """
    return contigs(table, F.pmod(bin_of, F.lit(bins)))


def two_level_of_words(nodes: DataFrame, bin_of: Callable[[np.ndarray], np.ndarray], k: int) -> DataFrame:
    """two_level() of rows of superkmers.unique_words() of odd k up to 31; bin_of makes the bins, few numbers, of some canonical k-mers as words.

    The steps within a bin of BLOCK nodes at most are walked together; those of larger bins and those across bins meet by minimizer, and what is cut there is merged in rounds.
    """

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bin_of(b.column(0).to_numpy().view(np.uint64)).astype(np.int32))], ["word", "l", "r", "bin"])

    # written, as bins are counted first
    rows = written(nodes.select("word", "l", "r").mapInArrow(binned, "word long, l byte, r byte, bin int"), "words")
    small = [r["bin"] for r in rows.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") <= BLOCK).select("bin").collect()]
    out = _contracted(compaction.words(rows.drop("bin"), k), k, lambda rest: contigs_of_pieces(rest, None, k), (bin_of, small) if small else None)
    discard(rows)
    return out


def assemble(reads: DataFrame, cfg: Config) -> DataFrame:
    """Contigs of at least the configured length, from reads."""
    found = of_reads(reads, cfg)
    return found.where(F.col("len") >= cfg.least_length)


def with_ids(found: DataFrame) -> DataFrame:
    """contig_id, from 1 by falling length and rising sequence, before the columns."""
    return kmers.numbered(found, F.col("len").desc(), F.col("seq")).select(F.col("n").alias("contig_id"), "seq", "left_ext", "right_ext", "len")


def extension_kmer(seq: Column | str, right_ext: Column | str, k: int) -> Column:
    """The k-mer that would come after a contig."""
    return F.concat(F.right(F.col(seq) if isinstance(seq, str) else seq, F.lit(k - 1)), F.col(right_ext) if isinstance(right_ext, str) else right_ext)


def fasta(found: DataFrame, cfg: Config) -> DataFrame:
    """contig_id and value, the lines of each contig: header, then the sequence in lines of the configured width."""
    head = F.format_string(">contig %d len %d left_ext %s right_ext %s\n", "contig_id", "len", "left_ext", "right_ext")
    body = F.regexp_replace("seq", f"(.{{{cfg.fasta_textwidth}}})(?!$)", "$1\n")
    return found.select("contig_id", F.concat(head, body).alias("value"))


def discard(*frames: DataFrame) -> None:
    for f in frames:
        drop_written(f)

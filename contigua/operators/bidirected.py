"""Contigs from a bidirected graph, with one node for each canonical k-mer, as rows of chunks.

A node has two ends. The k + 1 bases that it makes with its left or right base, on the smaller strand, are the key of that end; two ends of one key
are joined, and an end whose k + 1 bases are their own reverse complement is joined to itself, so that the path turns back there.

1. Nodes are dealt by the minimizer of either strand. Each task joins the nodes that it holds, block by block, to pieces, each once, not once for each
   strand. A minimizer with more nodes than a block has is dealt to several tasks.
2. Pieces are joined by pointer doubling over (piece, strand), by keys of their ends. Ranks carry the bases before a piece, so each piece knows its place
   in its path. Of a path and its mirror image one is kept. A circle is cut in the piece with its smallest k-mer.
3. Pieces are cut at the borders of chunks of their path and each chunk is joined alone. The strand of a contig is the smaller one by its first chunk from
   either end; only where these are equal do further chunks decide. No value is longer than a block's piece or a chunk, however long a contig is.

Results are those of contigs.contigs() for odd k. For even k, k-mers that are their own reverse complements are no nodes, as their ends cannot be told apart: paths
end beside them, and each other canonical k-mer is in one contig.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import dna, walks
from contigua.operators import compaction, kmers, ufx
from contigua.operators.contigs import _in_order, _letters, block_paths, blocks, dealt_by_bin, dealt_words, kmer_length, on_one_strand
from contigua.operators.storage import drop_written, written

#: Bases of a minimizer, nodes that a task joins at once, and bases of a chunk.
MINIMIZER, BLOCK, CHUNK = 11, 1 << 18, 1 << 12

_paired = str.maketrans(dna.BASES, dna.PAIRED)


def nodes(table: DataFrame) -> DataFrame:
    """u, l, r: the k-mers of a UFX table that are unique on both sides, each once."""
    return ufx.unique_both(table).where(F.col("kmer") != dna.revcomp("kmer")).select(F.col("kmer").alias("u"), ufx.unique_base("lmask").alias("l"), ufx.unique_base("rmask").alias("r"))


def minimizer(u: str, size: int = MINIMIZER) -> Column:
    """The smallest hash of a part of a k-mer or of its reverse complement."""
    n = F.least(F.lit(size), F.length(u))
    parts = lambda c: F.array_min(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.xxhash64(F.substr(c, i, n))))
    return F.least(parts(F.col(u)), parts(dna.revcomp(u)))


def turned(s: str) -> str:
    return s.translate(_paired)[::-1]


def walked(u: list[str], left: list[str], right: list[str]) -> Iterator[tuple[str, str, str, str, int, bool]]:
    """Of the paths among some nodes: seq, l and r, the smallest node on it, its place, and whether it is turned there; a circle is cut anywhere.

    Ends are numbered: 2 i is the left one of node i, 2 i + 1 the right one.
    """
    at: dict[str, int] = {}
    mate = [-1] * (2 * len(u))
    for i, (k, a, b) in enumerate(zip(u, left, right, strict=True)):
        for end, step in ((2 * i, a + k), (2 * i + 1, k + b)):
            back = turned(step)
            if step == back:
                continue  # joined to itself: the piece ends here
            other = at.setdefault(min(step, back), end)
            if other != end:
                mate[end], mate[other] = other, end
    seen = bytearray(len(u))
    begins = [e for e in range(2 * len(u)) if mate[e] < 0]
    for start in (*begins, *range(0, 2 * len(u), 2)):
        if seen[start >> 1]:
            continue
        first = last = start
        least, place, flip, n, bases = u[start >> 1], 0, bool(start & 1), 0, []
        while True:
            i, came = last >> 1, last & 1
            seen[i] = 1
            k = turned(u[i]) if came else u[i]
            bases.append(k if not n else k[-1])
            if u[i] < least:
                least, place, flip = u[i], n, bool(came)
            n += 1
            out = last ^ 1
            nxt = mate[out]
            if nxt < 0 or seen[nxt >> 1]:
                break
            last = nxt
        i, j = first >> 1, last >> 1
        yield "".join(bases), right[i].translate(_paired) if first & 1 else left[i], left[j].translate(_paired) if last & 1 else right[j], least, place, flip


PIECE = "seq string, l string, r string, least string, place int, flip boolean"


def pieces(found: DataFrame, size: int = MINIMIZER, block: int = BLOCK) -> DataFrame:
    """id and walked() of nodes that meet in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[str], ...] = ([], [], [])

        def result() -> Iterator[pa.RecordBatch]:
            if held[0]:
                columns = zip(*walked(*held), strict=True)
                kinds = pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["seq", "l", "r", "least", "place", "flip"])

        for b in batches:
            for into, column in zip(held, b.columns, strict=True):
                into += column.to_pylist()
            if len(held[0]) >= block:
                yield from result()
                held = ([], [], [])
        yield from result()

    # nodes of a minimizer that fills several blocks are dealt by themselves
    dealt = dealt_by_bin(found.withColumn("bin", minimizer("u", size)), F.col("u"), block).select("u", "l", "r")
    return dealt.mapInArrow(run, PIECE).withColumn("id", F.monotonically_increasing_id())


def of_words(k: int) -> bool:
    """Whether pieces are made of words: those have their own keys of ends."""
    return k % 2 == 1 and k <= 31


def word_pieces(table: DataFrame, k: int) -> DataFrame:
    """pieces() of a UFX table for odd k up to 31, walked over arrays; least is a word, and a and b are the keys of both ends, null where these turn."""

    def found(word: np.ndarray, l: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        places, begin = block_paths(word, l, r, k)
        # of each path and its mirror image, which follows it, the first
        size = np.diff(begin, append=len(places))[::2]
        own = np.flatnonzero(np.repeat(np.arange(len(begin)) % 2 == 0, np.diff(begin, append=len(places))))
        places, begin = places[own], np.cumsum(size) - size
        text, at, left, right, into, out = walks.sequences(places, begin, word, l, r, k)
        seq = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(text)]).cast(pa.string())
        node = word[places >> 1]
        least = np.minimum.reduceat(node, begin)
        # a k-mer is one node, so each path has one place of it
        nth = np.flatnonzero(node == np.repeat(least, size))
        key = lambda x: (lambda back: pa.array(np.minimum(x, back).view(np.int64), mask=x == back))(walks.turned(x, k + 1))
        columns = [seq, _letters(left), _letters(right), pa.array(least.view(np.int64)), pa.array((nth - begin).astype(np.int32)), pa.array((places[nth] & 1).astype(bool)), key(into), key(out)]
        return pa.RecordBatch.from_arrays(columns, ["seq", "l", "r", "least", "place", "flip", "a", "b"])

    rows = dealt_words(table, k, None).mapInArrow(blocks(found), "seq string, l string, r string, least long, place int, flip boolean, a long, b long")
    return rows.withColumn("id", F.monotonically_increasing_id())


def joined_nodes(table: DataFrame, k: int, size: int = MINIMIZER, block: int = BLOCK) -> DataFrame:
    """The pieces of a UFX table: of words where k allows."""
    return word_pieces(table, k) if of_words(k) else pieces(nodes(table), size, block)


def ends(found: DataFrame, k: int) -> DataFrame:
    """id, side (0 or 1), key, and turns: whether the key is its own reverse complement."""
    step = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.concat("l", F.substring("seq", 1, k)).alias("step")), F.struct(F.lit(1).alias("side"), F.concat(F.right("seq", F.lit(k)), "r").alias("step"))))
    rows = found.select("id", step.alias("e")).select("id", "e.side", "e.step", dna.revcomp("e.step").alias("back"))
    return rows.select("id", "side", F.least("step", "back").alias("key"), (F.col("step") == F.col("back")).alias("turns"))


def links(found: DataFrame, k: int) -> DataFrame:
    """from and to: pieces with their strand, as 2 * id + strand, that follow each other. Strand 1 leaves by side 0 and is entered by side 1."""
    if of_words(k):
        # an end is 2 * id + side; a key has two ends at most, so nothing is collected
        at = F.col("id") * 2
        one = found.select(F.explode(F.array(F.struct(F.col("a").alias("key"), at.alias("end")), F.struct(F.col("b").alias("key"), (at + 1).alias("end")))).alias("e"), "id").select("e.key", "e.end")
        both = one.where("key is not null").repartition("key").groupBy("key").agg(F.min("end").alias("x"), F.max("end").alias("y")).where("x <> y")
        flip = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
        ways = F.array(F.struct(flip("x").alias("from"), F.col("y").alias("to")), F.struct(flip("y").alias("from"), F.col("x").alias("to")))
        turns = [found.where(F.col(c).isNull()).select((at + 1 - side).alias("from"), (at + side).alias("to")) for side, c in enumerate("ab")]
        return both.select(F.explode(ways).alias("w")).select("w.from", "w.to").unionAll(turns[0]).unionAll(turns[1])
    rows = written(ends(found, k), "ends")
    # a key has two ends at most, so a group of it is a row or two
    both = rows.where("not turns").groupBy("key").agg(F.min(F.struct("id", "side")).alias("a"), F.max(F.struct("id", "side")).alias("b")).where("a <> b")
    pair = both.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    pair = pair.unionAll(rows.where("turns").select(F.struct("id", "side").alias("a"), F.struct("id", "side").alias("b")))
    return pair.select((2 * F.col("a.id") + 1 - F.col("a.side")).alias("from"), (2 * F.col("b.id") + F.col("b.side")).alias("to"))


def ranked(codes: DataFrame, edges: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """u, head, d (steps from it) and at (bases of those before) of the pieces on paths; and u and size of those on circles.

    codes: u and size, the bases that a piece adds. In each round a piece that has not met its head asks the one it points to, twice as far back as the
    round before. Pieces on circles never meet one: rounds end when no piece is settled any more.
    """
    before = edges.select(F.col("to").alias("u"), F.col("from").alias("head")).join(codes.select(F.col("u").alias("head"), F.col("size").alias("at")), "head")
    now = codes.select("u").join(before, "u", "left")
    now = written(now.select("u", F.coalesce("head", "u").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("d"), F.coalesce("at", F.lit(0).cast("long")).alias("at"), F.col("head").isNull().alias("done")), "ranks")
    scratch.append(now)
    settled, was, left = [now.where("done")], None, now.where("not done").count()
    pool = now
    while left and left != was:
        asked = pool.select(F.col("u").alias("head"), F.col("head").alias("head2"), F.col("d").alias("d2"), F.col("at").alias("at2"), F.col("done").alias("done2"))
        nxt = pool.where("not done").join(asked, "head")
        nxt = written(nxt.select("u", "head", F.col("head2"), (F.col("d") + F.col("d2")).alias("d"), (F.col("at") + F.col("at2")).alias("at"), F.col("done2").alias("done"), "d2", "at2"), "ranks")
        scratch.append(nxt)
        now = nxt.select("u", F.col("head2").alias("head"), "d", "at", "done")
        settled.append(now.where("done"))
        # settled ones that were asked may be asked again by those further on
        pool = now.unionAll(nxt.where("done").select(F.col("head").alias("u"), F.col("head2").alias("head"), F.col("d2").alias("d"), F.col("at2").alias("at"), "done"))
        was, left = left, now.where("not done").count()
    out = settled[0]
    for x in settled[1:]:
        out = out.unionAll(x)
    return out.select("u", "head", "d", "at"), now.where("not done").select("u").join(codes, "u")


def _oriented(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of labels (u), with seq, l, r, place and n (k-mers) of its piece on its strand; place is null where the smallest k-mer is turned."""
    rows = labels.join(found.withColumnRenamed("id", "_id"), F.shiftright("u", 1) == F.col("_id")).drop("_id")
    back = F.col("u").bitwiseAND(F.lit(1)) == 1
    pick = lambda yes, no: F.when(back, yes).otherwise(no)
    return rows.select(
        *labels.columns,
        pick(dna.revcomp("seq"), F.col("seq")).alias("seq"),
        pick(dna.complement("r"), F.col("l")).alias("l"),
        pick(dna.complement("l"), F.col("r")).alias("r"),
        "least",
        F.when(back == F.col("flip"), pick(F.col("n") - 1 - F.col("place"), F.col("place"))).alias("place"),
    )


def _opened(found: DataFrame, circles: DataFrame, edges: DataFrame, k: int, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces, codes and edges of circles, each cut in the piece with its smallest k-mer: that begins the first piece and ends the last one."""
    on = edges.join(circles.select(F.col("u").alias("from")), "from", "left_semi")
    now = written(_oriented(found, circles.select("u")).join(on.select(F.col("from").alias("u"), "to"), "u").select("u", "to", F.col("least").alias("own"), "least", "place"), "circles")
    scratch.append(now)
    n, reach = now.count(), 1
    while reach < n:
        ahead = now.select(F.col("u").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        now = written(now.join(ahead, "to").select("u", F.col("to2").alias("to"), "own", F.least("least", "least2").alias("least"), "place"), "circles")
        scratch.append(now)
        reach *= 2
    start = now.where("own = least and place is not null").select("u")
    # a piece that lies on its circle on both strands begins it once
    start = written(start.groupBy(F.shiftright("u", 1).alias("id")).agg(F.min("u").alias("u")).select("u"), "circles")
    scratch.append(start)
    cut = _oriented(found, start)
    base = lambda i: F.substr("seq", i, F.lit(1))
    place, n_ = F.col("place"), F.length("seq") - k + 1
    l, r = F.when(place == 0, F.col("l")).otherwise(base(place)), F.when(place == n_ - 1, F.col("r")).otherwise(base(place + k + 1))
    first = F.struct((4 * F.col("u")).alias("u"), F.substr("seq", place + 1).alias("seq"), l.alias("l"), F.col("r"))
    last = F.struct((4 * F.col("u") + 1).alias("u"), F.substr("seq", F.lit(1), place + k).alias("seq"), F.col("l"), r.alias("r"))
    halves = cut.select(F.explode(F.array(first, last)).alias("h")).select("h.*")
    others = _oriented(found, circles.select("u").join(start, "u", "left_anti")).select((4 * F.col("u")).alias("u"), "seq", "l", "r")
    parts = written(halves.unionAll(others), "parts")
    scratch.append(parts)
    into = on.join(start.select(F.col("u").alias("to"), F.lit(1).alias("half")), "to", "left").select((4 * F.col("from")).alias("from"), (4 * F.col("to") + F.coalesce("half", F.lit(0))).alias("to"))
    return parts, parts.select("u", (F.length("seq") - (k - 1)).cast("long").alias("size")), into


def parts_of(table: DataFrame, scratch: list[DataFrame], size: int = MINIMIZER, block: int = BLOCK, k: int | None = None) -> DataFrame:
    """head, at, bases, l, r: the pieces of each path without what they share with the one before, by the place where these bases begin.

    l and r are the bases before the first and after the last piece, else null.
    """
    k = kmer_length(table) if k is None else k
    keep = lambda df, what: scratch.append(written(df, what)) or scratch[-1]
    found = keep(joined_nodes(table, k, size, block).withColumn("n", F.length("seq") - k + 1), "pieces")
    edges = keep(links(found, k), "links")
    codes = found.select(F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("u"), (F.length("seq") - (k - 1)).cast("long").alias("size"))
    labels, circles = ranked(codes, edges, scratch)
    # of a path and its mirror image, whose head is the tail on the other strand, the one with the smaller head
    tails = labels.groupBy("head").agg(F.max(F.struct("d", "u")).alias("tail")).select("head", "tail.u", "tail.d")
    chosen = tails.where(F.col("head") <= F.col("u").bitwiseXOR(F.lit(1).cast("long"))).select("head", F.col("d").alias("last"))
    rows = _oriented(found, labels.join(chosen, "head"))
    place = lambda rows: rows.select(
        "head",
        F.when(F.col("d") == 0, F.col("at")).otherwise(F.col("at") + (k - 1)).alias("at"),
        F.when(F.col("d") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(k))).alias("bases"),
        F.when(F.col("d") == 0, F.col("l")).alias("l"),
        F.when(F.col("d") == F.col("last"), F.col("r")).alias("r"),
    )
    out = place(rows)
    circles = keep(circles, "circles")
    if not circles.isEmpty():
        parts, codes, edges = _opened(found, circles, edges, k, scratch)
        again, rest = ranked(codes, edges, scratch)
        # the mirror image of a circle has no start and stays one; paths on circles are told from others by heads below 0
        lasts = again.groupBy("head").agg(F.max("d").alias("last"))
        out = out.unionAll(place(again.join(lasts, "head").join(parts, "u").withColumn("head", -1 - F.col("head"))))
    return out


def chunked(parts: DataFrame, size: int) -> DataFrame:
    """head, chunk and bases of parts (head, at, bases), cut at multiples of `size`."""
    n = F.length("bases")
    spans = F.sequence((F.col("at") / size).cast("long"), ((F.col("at") + n - 1) / size).cast("long"))
    cut = parts.where(n > 0).select("head", "at", "bases", F.explode(spans).alias("chunk"))
    begin = F.greatest(F.col("at"), F.col("chunk") * size)
    end = F.least(F.col("at") + n, (F.col("chunk") + 1) * size)
    cut = cut.select("head", "chunk", begin.alias("at"), F.substr("bases", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("bases"))
    return cut.groupBy("head", "chunk").agg(_in_order("at", "bases").alias("bases"))


def _mirrored(parts: DataFrame) -> DataFrame:
    """Parts (head, at, bases, len) on the other strand."""
    return parts.select("head", (F.col("len") - F.col("at") - F.length("bases")).alias("at"), dna.revcomp("bases").alias("bases"), "len")


def _turned_heads(parts: DataFrame, size: int) -> DataFrame:
    """head of the paths whose other strand is smaller."""

    def compared(rows: DataFrame, most: Column | None) -> DataFrame:
        here, there = rows, _mirrored(rows)
        if most is not None:
            here, there = here.where(most), there.where(most)
        a, b = chunked(here, size), chunked(there, size).withColumnRenamed("bases", "back")
        return a.join(b, ["head", "chunk"]) if most is None else a.where("chunk = 0").join(b.where("chunk = 0"), ["head", "chunk"])

    first = written(compared(parts, F.col("at") < size), "strands")
    same = written(first.where("bases = back").join(parts.where(F.col("len") > size).select("head").distinct(), "head", "left_semi").select("head"), "strands")
    out = first.where("back < bases").select("head")
    if not same.isEmpty():
        rest = compared(parts.join(same, "head", "left_semi"), None).where("bases <> back")
        out = out.unionAll(rest.groupBy("head").agg(F.min(F.struct("chunk", (F.col("back") < F.col("bases")).alias("turn"))).alias("f")).where("f.turn").select("head"))
    found = written(out, "strands")
    drop_written(first)
    drop_written(same)
    return found


def contig_chunks(table: DataFrame, least: int = 0, size: int = CHUNK, minimizer_size: int = MINIMIZER, block: int = BLOCK, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """contig_id, len, left_ext, right_ext of contigs of at least `least` bases, and their contig_id, chunk, bases.

    table: a UFX table or, with odd k up to 31, superkmers.unique_words(). Ids go by falling length and rising sequence, as those of contigs.with_ids(); sequences are compared chunk by chunk where lengths and first chunks are equal.
    """
    short, named, chunks, scratch = _found(table, least, size, minimizer_size, block, k)
    rows = kmers.numbered(short.unionByName(named), F.col("len").desc(), F.col("first"), F.col("tie")).withColumnRenamed("n", "contig_id")
    ids = rows.select("contig_id", "len", "left_ext", "right_ext")
    out = _cut(rows.where("head is null"), size, "contig_id").select("contig_id", "chunk", "bases")
    if chunks is not None:
        out = out.unionAll(written(chunks.join(rows.where("head is not null").select("contig_id", "head"), "head").select("contig_id", "chunk", "bases"), "chunks"))
    for x in scratch:
        drop_written(x)
    return ids, out


def named_chunks(table: DataFrame, least: int = 0, size: int = CHUNK, k: int | None = None) -> DataFrame:
    """Both tables of contig_chunks() in one, contig_id, len, left_ext, right_ext, chunk and bases; only chunks of contigs that are not one value are joined."""
    short, named, chunks, scratch = _found(table, least, size, MINIMIZER, BLOCK, k)
    rows = kmers.numbered(short.unionByName(named), F.col("len").desc(), F.col("first"), F.col("tie")).withColumnRenamed("n", "contig_id")
    columns = "contig_id", "len", "left_ext", "right_ext", "chunk", "bases"
    out = _cut(rows.where("head is null"), size, *columns[:4]).select(*columns)
    if chunks is not None:
        out = out.unionAll(written(chunks.join(rows.where("head is not null"), "head").select(*columns), "chunks"))
    for x in scratch:
        drop_written(x)
    return out


def whole_contigs(table: DataFrame, k: int | None = None) -> DataFrame:
    """whole() of contig_chunks(), without ids."""
    short, named, chunks, scratch = _found(table, 0, CHUNK, MINIMIZER, BLOCK, k)
    out = short.select(F.col("first").alias("seq"), "left_ext", "right_ext", "len")
    if chunks is not None:
        long = named.where("head is not null").withColumnRenamed("head", "contig_id")
        out = out.unionAll(named.where("head is null").select(F.col("first").alias("seq"), "left_ext", "right_ext", "len")).unionAll(whole(long, chunks.withColumnRenamed("head", "contig_id")))
    out = written(out, "contigs")
    for x in scratch:
        drop_written(x)
    return out


def _cut(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """columns, chunk and bases of contigs that are one value, first."""
    last = F.expr(f"cast((len - 1) div {size} as bigint)")
    return rows.select(*columns, "first", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).withColumn("bases", F.substr("first", (F.col("chunk") * size + 1).cast("int"), F.lit(size)))


def _found(table: DataFrame, least: int, size: int, minimizer_size: int, block: int, k: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame]]:
    """Contigs as rows of head, len, left_ext, right_ext, first and tie: those that compaction makes whole, and others. Where head is null first is the whole sequence;
    with a head it is the first of the chunks (head, chunk, bases), which are None if there are no others. Contigs of one length are all of one kind.
    """
    k = kmer_length(table) if k is None else k
    scratch: list[DataFrame] = []
    if not of_words(k):
        named, chunks = _chunked_paths(table, scratch, least, size, minimizer_size, block, k)
        return named.limit(0), named, chunks, scratch
    longest = compaction.LONGEST
    walked_, rest = compaction.contracted(compaction.words(table, k), k, scratch, longest)
    lone = lambda rows: rows.select(F.lit(None).cast("long").alias("head"), "len", "left_ext", "right_ext", F.col("seq").alias("first"), F.lit(0).alias("tie"))
    short = lone(on_one_strand(walked_).where(F.col("len") >= least))
    scratch.append(written(rest, "nodes"))
    if scratch[-1].isEmpty():
        return short, short.limit(0), None, scratch
    named, chunks = _chunked_paths(scratch[-1], scratch, least, size, minimizer_size, block, k)
    few = chunks.join(named.where(F.col("len") <= longest).select("head"), "head", "left_semi").groupBy("head").agg(_in_order("chunk", "bases").alias("seq"))
    others = lone(named.drop("first").join(few, "head")).unionByName(named.where(F.col("len") > longest))
    scratch.append(written(others, "heads"))
    return short, scratch[-1], chunks, scratch


def _chunked_paths(table: DataFrame, scratch: list[DataFrame], least: int, size: int, minimizer_size: int, block: int, k: int) -> tuple[DataFrame, DataFrame]:
    """head, len, left_ext, right_ext, first (chunk) and tie of contigs by pointer doubling, and head, chunk and bases."""
    keep = lambda df, what: scratch.append(written(df, what)) or scratch[-1]
    parts = keep(parts_of(table, scratch, minimizer_size, block, k), "parts")
    heads = parts.groupBy("head").agg(F.max(F.col("at") + F.length("bases")).cast("long").alias("len"), F.max("l").alias("l"), F.max("r").alias("r")).where(F.col("len") >= least)
    heads = keep(heads, "heads")
    parts = keep(parts.select("head", "at", "bases").join(heads.select("head", "len"), "head"), "parts")
    turned_ = keep(_turned_heads(parts, size).withColumn("turn", F.lit(True)), "strands")
    marked = keep(heads.join(turned_, "head", "left").withColumn("turn", F.coalesce("turn", F.lit(False))), "heads")
    ways = parts.join(marked.select("head", "turn"), "head")
    oriented = ways.where("not turn").select("head", "at", "bases").unionAll(_mirrored(ways.where("turn").select("head", "at", "bases", "len")).select("head", "at", "bases"))
    chunks = keep(chunked(oriented, size), "chunks")
    pick = lambda yes, no: F.when(F.col("turn"), yes).otherwise(no)
    named = marked.select("head", "len", pick(dna.complement("r"), F.col("l")).alias("left_ext"), pick(dna.complement("l"), F.col("r")).alias("right_ext"))
    named = keep(named.join(chunks.where("chunk = 0").select("head", F.col("bases").alias("first")), "head"), "heads")
    named = named.join(_ties(named, chunks, scratch), "head", "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    return keep(named.select("head", "len", "left_ext", "right_ext", "first", "tie"), "heads"), chunks


def _ties(named: DataFrame, chunks: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """head and tie: the order of contigs of equal length and first chunk by their further chunks."""
    alike = named.groupBy("len", "first").agg(F.count("*").alias("n")).where("n > 1").select("len", "first", F.monotonically_increasing_id().alias("bunch"))
    now = written(named.join(alike, ["len", "first"]).select("bunch", "head", F.lit(0).alias("tie")), "ties")
    scratch.append(now)
    chunk = 1
    while not now.groupBy("bunch", "tie").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        with_next = now.join(chunks.where(F.col("chunk") == chunk).select("head", "bases"), "head", "left")
        if with_next.where("bases is not null").isEmpty():
            break
        order = Window.partitionBy("bunch").orderBy("tie", "bases")
        now = written(with_next.select("bunch", "head", F.rank().over(order).alias("tie")), "ties")
        scratch.append(now)
        chunk += 1
    return now.select("head", "tie")


def whole(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """seq, left_ext, right_ext, len of contigs, for callers who want each as one value."""
    seqs = chunks.groupBy("contig_id").agg(_in_order("chunk", "bases").alias("seq"))
    return ids.join(seqs, "contig_id").select("seq", "left_ext", "right_ext", "len")


def chunk_size(cfg: Config, size: int = CHUNK) -> int:
    """The largest multiple of the line width that is not above `size`, one line at least: so no line crosses chunks."""
    return max(1, size // cfg.fasta_textwidth) * cfg.fasta_textwidth


def fasta(ids: DataFrame, chunks: DataFrame, cfg: Config) -> DataFrame:
    """contig_id, chunk and value: the lines of each chunk of chunk_size() bases, the first one after its contig's header."""
    return fasta_lines(chunks.join(ids, "contig_id"), cfg)


def fasta_lines(rows: DataFrame, cfg: Config) -> DataFrame:
    """fasta() of named_chunks()."""
    lines = F.regexp_replace("bases", f"(.{{{cfg.fasta_textwidth}}})(?!$)", "$1\n")
    head = F.format_string(">contig %d len %d left_ext %s right_ext %s\n", "contig_id", "len", "left_ext", "right_ext")
    return rows.select("contig_id", "chunk", F.when(F.col("chunk") == 0, F.concat(head, lines)).otherwise(lines).alias("value"))

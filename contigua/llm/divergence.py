"""Source divergence audit: how far the word shares of the sources of a language lie apart, and which words make a source stand out.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms that at least LEAST of its documents
have. Each source of a language, and the language, gives each kept term a smoothed share in whole billionths. Part `pair` has the sum of the
differences of shares for each two sources of a language; part `term` the TOP kept terms of each source whose share is most above the language's.

Texts are counted by the tasks that read them; counts are combined before and after their one shuffle. Kept terms are dealt to chunks of about CHUNK
terms by hash, so that a source's counts are packed vectors of bounded size, whatever the vocabulary. Sources are dealt to blocks of about BLOCK, and
each packed vector is copied to the tiles (block, block) of its language; a tile's task reads the vectors of both blocks chunk after chunk and adds up
its part of the matrix. It holds one chunk of two blocks at a time. Beyond SPAN chunks a tile is cut along the vocabulary, too, and its parts are added up.

Defined cases: null text, lang and source are ''; rows count one by one, repeated ones and those with a null doc_id included; a text without terms
still makes its source occur; a language without kept terms has pairs of value 0 and no terms; a single source has no pairs. Texts are read whole.
Extra columns are ignored. An empty table gives no rows. All arithmetic is exact up to 9e15 occurrences of kept terms in a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, text_bytes, written

#: Documents of a language that a kept term is in at least; terms that are told of each source at most.
LEAST, TOP = 30, 50
#: A share is 1 + floor(BILLION * (count + SMOOTH) / (total + SMOOTH * terms)).
SMOOTH, BILLION = 5, 1_000_000_000
#: Terms of a chunk and sources of a block, on average; chunks that one task of a tile reads at most.
CHUNK, BLOCK, SPAN = 4096, 64, 256
#: Languages or sources that are broadcast at most.
FEW = 20_000
#: Different terms, and documents, that a task holds before it passes its counts on; bytes of a text that are cut into terms at once.
HELD, SLICE = 1 << 18, 1 << 22

_lower = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in range(97, 123):
    _lower[_c] = _lower[_c - 32] = _c
LETTERS = bytes(_lower)
#: Documents are counted above the bits of occurrences, which HELD documents do not fill.
DOCUMENT = 1 << 44


def _terms(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    if len(text) <= SLICE:
        return Counter(text.translate(LETTERS).split())
    out: Counter = Counter()
    rest = b""
    for at in range(0, len(text), SLICE):
        part = rest + text[at : at + SLICE].translate(LETTERS)
        cut = part.rfind(b" ") + 1
        # a term that reaches the end may go on
        rest = part[cut:]
        out.update(part[:cut].split())
    out.update(rest.split())
    return out


def counted(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs, partial sums of each task; a row without term for each source that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = docs = 0

        def result() -> Iterator[pa.RecordBatch]:
            for (a, b), terms in held.items():
                values = np.array(list(terms.values()), np.int64)
                n = len(values)
                columns = pa.array([a] * (n + 1)), pa.array([b] * (n + 1)), pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array(np.r_[0, values % DOCUMENT]), pa.array(np.r_[0, values // DOCUMENT])
                yield pa.RecordBatch.from_arrays(list(columns), ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                group = held.setdefault((a, b), {})
                before = len(group)
                get = group.get
                for t, n in _terms(data).items():
                    group[t] = get(t, 0) + n + DOCUMENT
                size, docs = size + len(group) - before, docs + 1
                if size >= HELD or docs >= HELD:
                    yield from result()
                    held.clear()
                    size = docs = 0
        yield from result()

    body = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.select(body(lang).alias("lang"), body(source).alias("source"), body(text).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """The smoothed share in billionths; the product is taken as a decimal, as 64 bits would overflow."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    up = F.lit(BILLION).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    return 1 + F.call_function("div", up, (total + SMOOTH * terms).cast("decimal(19,0)"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """share() of an array, by long division in three steps of a thousand."""
    under = max(1, total + SMOOTH * terms)
    rest, out = counts + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + whole
    return out + 1


def tiled(vectors: DataFrame) -> DataFrame:
    """lang, a, b and value: for each two sources of a tile the sum of the differences of shares over the tile's chunks.

    vectors: lang, low, high, span, chunk, block, source, total, terms, size, at and n, one row for each source and chunk of a tile.
    """
    names = ["lang", "a", "b", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, rows = None, None, []
        sources: list[tuple[int, str]] = []
        sums, cut = np.zeros((0, 0), np.int64), 0

        def add() -> None:
            nonlocal sources, sums, cut
            here = [(r[0], r[1]) for r in rows]
            if not sources:
                sources, sums = here, np.zeros((len(here), len(here)), np.int64)
                # sources come by block: the first ones are compared with those of the other block, or all with each other
                cut = len(here) if tile[1] == tile[2] else sum(block == tile[1] for block, _ in here)
            assert here == sources, "each chunk has all sources of its tile"
            p = np.empty((len(rows), rows[0][4]), np.int64)
            for i, (_, _, total, terms, size, at, n) in enumerate(rows):
                full = np.zeros(size, np.int64)
                full[at] = n
                p[i] = shares(full, total, terms)
            for i in range(cut):
                first = i + 1 if tile[1] == tile[2] else cut
                sums[i, first:] += np.abs(p[first:] - p[i]).sum(axis=1)

        def result() -> Iterator[pa.RecordBatch]:
            i, j = np.triu_indices(len(sources), 1)
            if tile[1] != tile[2]:
                across = (i < cut) & (j >= cut)
                i, j = i[across], j[across]
            if len(i):
                of = [s for _, s in sources]
                yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(i)), pa.array([of[x] for x in i]), pa.array([of[x] for x in j]), pa.array(sums[i, j])], names)

        for b in batches:
            lang, low, high, span, chunks, block, source, total, terms, size = (c.to_pylist() for c in b.columns[:10])
            for r in range(b.num_rows):
                if (now := (lang[r], low[r], high[r], span[r])) != tile or chunks[r] != chunk:
                    if rows:
                        add()
                        rows.clear()
                    if now != tile:
                        if tile is not None:
                            yield from result()
                        tile, sources = now, []
                    chunk = chunks[r]
                rows.append((block[r], source[r], total[r], terms[r], size[r], b.column(10)[r].values.to_numpy(), b.column(11)[r].values.to_numpy()))
        if rows:
            add()
            yield from result()

    keys = "lang", "low", "high", "span"
    dealt = vectors.repartition(*keys).sortWithinPartitions(*keys, "chunk", "block", "source")
    dealt = dealt.select(*keys, "chunk", "block", "source", "total", "terms", "size", "at", "n")
    return dealt.mapInArrow(run, "lang string, a string, b string, value long")


def _near(rows: DataFrame, what: str, most: int = FEW) -> DataFrame:
    """rows, written, and broadcast where they are few by count: a frequent key of the other side then stays where it is."""
    found = written(rows, what)
    if found.count() > most:
        return found
    out = F.broadcast(found)
    out.written_to = found.written_to
    return out


def audited(documents: DataFrame, least: int = LEAST, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value and rank: see above."""
    counts = written(counted(documents).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least).select("lang", "term", "all")
    kept = written(kept, "kept")
    of_lang = _near(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total")), "langs")
    # a term's place within its chunk: windows of about `chunk` rows
    chunks = lambda terms: F.greatest(F.lit(1), F.ceil(terms / chunk)).cast("int")
    in_chunk = Window.partitionBy("lang", "chunk")
    placed = kept.join(of_lang, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks(F.col("terms"))).cast("int"))
    placed = written(placed.repartition("lang", "chunk").withColumn("at", F.row_number().over(in_chunk.orderBy("term")) - 1), "placed")
    known = written(counts.where("term is not null").select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "known")

    groups = counts.where("term is null").select("lang", "source").distinct()
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(of_lang.select("lang", "terms"), "lang", "left").fillna(0, ["total", "terms"])
    groups = _near(groups, "groups")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))

    packed = known.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("v")).select("lang", "source", "chunk", "v.at", "v.n")
    sizes = placed.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
    each = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    each = each.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks(F.col("terms")) - 1)))
    each = each.join(sizes, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left").fillna(0, ["size"])
    each = each.withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "n": F.coalesce("n", F.array().cast("array<long>"))})
    tiles = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "span": (F.col("chunk") / span).cast("int")})
    half = written(tiled(tiles), "pairs")
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = both.repartition("lang", "source").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share("n", "total", "terms"), share("all", "lang_total", "terms")
    above = known.join(groups.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
    out = written(ranked(pairs, "pair").unionAll(ranked(above, "term").where(F.col("rank") <= top)), "audit")
    for x in (counts, kept, of_lang, placed, known, groups, half):
        drop_written(x)
    return out

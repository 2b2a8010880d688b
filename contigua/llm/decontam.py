"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping pieces, and runs of ten words are searched verbatim beside them, so that thirteen words of an
item are found at any offset. A text region within k edits of a piece of m bytes shares at
least m - q + 1 - kq of its q-grams with it, on diagonals that differ by k at most. So the shared q-grams of text and
pieces are counted in overlapping diagonal bands, of 2k diagonals every k, and only bands that reach that bound are
aligned, by edit distance within the band. Text and items are compared in ASCII lower case with runs of
white space as one space.

Rules of one character or pattern are ordinary in texts and items. Runs of one q-gram, in a text and in a piece, are a rectangle of places whose diagonals are
counted by formula; places are counted for some pieces at a time, or for one with many places in parts; bands with equal bytes are aligned once. So what is
held does not grow with how often a q-gram repeats.

The benchmark is a stated query set. Its pieces are cut by tasks and written; blocks of about BLOCK_BYTES of pieces then go to
the tasks one after the other, with a pass over the documents for each, whose matches are written before the next block is read. So neither
a task nor the driver holds more than a block, however large the benchmark or one item is. Documents are not shuffled to be searched; only
the matches are, to be summed up by document and item.

Defined cases: null and empty texts match nothing; items of fewer than LEAST bytes after normalising are too
short to tell and match nothing, as null items; rows that repeat a doc_id are summed up as one document, and
repeated item_ids as one item; items with a null id match nothing; a null doc_id stays null and is summed up as one document. Texts of any
length are read whole, in parts that overlap in what is left of white space; what is found twice counts once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, text_bytes, written

Q = 8
PIECE = 100
STRIDE = 50
#: Edits allowed, as a share of a piece.
EDITS = 0.1
LEAST = 20
#: Any EXCERPT words in a row of an item hold one of its runs of RUN words, one every EXCERPT - RUN + 1, which are searched verbatim.
EXCERPT, RUN = 13, 10
BLOCK_BYTES = 4 << 20
#: Bytes of text that are searched at once, and normalised ones by which parts of a long text overlap: more than a region has.
PART, OVERLAP = 2 << 20, 512
SIEVE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands between texts; it is no byte of a normalised item.
GAP = b"\x00" * 16

_blank = np.zeros(256, bool)
_blank[list(b" \t\n\x0b\x0c\r\x00")] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[_blank] = 32


def normalised(data: bytes, after_blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are compared, and the place of each in data; white space at the end is one space."""
    a = np.frombuffer(data, np.uint8)
    blank = _blank[a]
    keep = np.flatnonzero(~(blank & np.r_[after_blank, blank[:-1]])) if len(a) else np.zeros(0, np.int64)
    return _fold[a[keep]], keep


def trimmed(data: bytes) -> np.ndarray:
    """The bytes of an item that are compared."""
    a, _ = normalised(data, True)
    return a[:-1] if len(a) and a[-1] == 32 else a


def parts(data: bytes, size: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Normalised parts of a text that overlap, the places of their bytes, and how many normalised bytes come before each."""
    size = size or PART
    held, places, blank, before = np.zeros(0, np.uint8), np.zeros(0, np.int64), False, 0
    for shift in range(0, max(1, len(data)), size):
        a, at = normalised(data[shift : shift + size], blank)
        held, places = np.concatenate([held, a]), np.concatenate([places, at + shift])
        yield held, places, before
        blank = shift + size <= len(data) and bool(_blank[data[shift + size - 1]])
        cut = max(0, len(held) - OVERLAP)
        held, places, before = held[cut:], places[cut:], before + cut


def grams(a: np.ndarray) -> np.ndarray:
    """Each 8 bytes in a row, as one number."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    two = a[:-1].astype(np.uint16) | a[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    return four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)


def budget(m: int) -> int:
    """Edits allowed for a piece of m bytes; few enough that five shared q-grams must be left."""
    return max(0, min(int(m * EDITS), (m - Q - 4) // Q))


def _stretched(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first .. first + n - 1 of each item, one after the other."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _batches(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose weights add up to `most`, one item at least."""
    total, begin = np.r_[0, np.cumsum(weight)], 0
    while begin < len(weight):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def _triangle(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * (x + 1) // 2


class Index:
    """q-grams of some different pieces, and the items of each. Where a q-gram repeats in a row, in a text or in a piece, its places are one run, so that rules of one character are few places."""

    def __init__(self, items: dict[tuple[bytes, bool], list[int]]):
        pieces, verbatim = [p for p, _ in items], [v for _, v in items]
        self.items = list(items.values())
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.edits = np.array([budget(m) for m in self.size], np.int64)
        self.bound = self.size - Q + 1 - self.edits * Q
        # a verbatim region has all q-grams of its piece, so one of Q tells enough
        self.exact = exact = np.array(verbatim, bool)
        self.edits[exact] = 0
        self.bound = np.where(exact, self.size // Q, self.bound)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), self.size)
        offset = (np.arange(len(self.data)) - self.start[piece]).astype(np.int32)
        place = np.flatnonzero((offset + Q <= self.size[piece]) & (~exact[piece] | (offset % Q == 0))) if len(pieces) else np.zeros(0, np.int64)
        self.grams, gram = np.unique(grams(self.data)[place], return_inverse=True)
        piece, offset = piece[place], offset[place]
        new = np.r_[True, (piece[1:] != piece[:-1]) | (gram[1:] != gram[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(place) else np.zeros(0, bool)
        # postings: runs of one q-gram, by piece
        at = np.flatnonzero(new)
        self.piece, self.offset, self.gram = piece[at], offset[at], gram[at].astype(np.int32)
        self.run = np.diff(np.r_[at, len(place)]).astype(np.int32)
        # at most an eighth of the sieve is set
        self.shift = np.uint64(64 - max(SIEVE_BITS, (8 * len(self.grams)).bit_length()))
        self.sieve = np.zeros(1 << (64 - int(self.shift)), bool)
        self.sieve[self.grams * MIX >> self.shift] = True

    @property
    def pieces(self) -> list[tuple[int, np.ndarray]]:
        return [(i[0], self.data[s:e]) for i, s, e in zip(self.items, self.start[:-1], self.start[1:], strict=True)]

    def candidates(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(piece, lowest diagonal) of the bands that hold enough shared q-grams, in batches of some pieces."""
        g = grams(a)
        if not len(self.grams) or not len(g):
            return
        at = np.flatnonzero(self.sieve[g * MIX >> self.shift])
        i = np.searchsorted(self.grams, g[at])
        i[i == len(self.grams)] = 0
        hit = self.grams[i] == g[at]
        at, i = at[hit], i[hit]
        if not len(at):
            return
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (i[1:] != i[:-1])])
        start, length, gram = at[new], np.diff(np.r_[new, len(at)]), i[new]
        order = np.argsort(gram, kind="stable")
        start, length = start[order], length[order]
        runs = np.bincount(gram, minlength=len(self.grams))
        first = np.r_[0, np.cumsum(runs)[:-1]]
        steps = np.bincount(gram, weights=np.diff(np.r_[new, len(at)]), minlength=len(self.grams))
        act = np.flatnonzero(runs[self.gram] > 0)
        # a piece needs as many places whose q-gram the text has at all
        act = act[(np.bincount(self.piece[act], self.run[act], minlength=len(self.size)) >= self.bound)[self.piece[act]]]
        step = np.maximum(1, self.edits)
        whole = self.exact[self.piece[act]]
        yield from self._anchored(act[whole], runs, steps, first, start, length)
        act = act[~whole]
        if not len(act):
            return
        # cells that the runs of a posting reach at most: each run is a rectangle of places in the text and in the piece
        n = runs[self.gram[act]]
        cells = (steps[self.gram[act]] + n * (self.run[act] - 1.0)) / step[self.piece[act]] + 2 * n
        width = len(a) + 2 * PIECE + 2
        each = np.r_[0, np.flatnonzero(np.diff(self.piece[act])) + 1, len(act)]
        weight = np.add.reduceat(cells, each[:-1])
        for p, q in _batches(weight, LIMIT):
            some = act[each[p] : each[q]]
            piece, band = (self._dense if q == p + 1 and weight[p] > LIMIT else self._sparse)(some, runs, first, start, length, width)
            if len(piece):
                yield piece, band * step[piece] - PIECE

    def _anchored(self, act: np.ndarray, runs: np.ndarray, steps: np.ndarray, first: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of pieces that are searched verbatim: all places of that of their q-grams which the text has least often."""
        act = act[np.lexsort((steps[self.gram[act]], self.piece[act]))]
        act = act[np.r_[True, np.diff(self.piece[act]) != 0]] if len(act) else act
        entry = lambda x: _stretched(first[self.gram[x]], runs[self.gram[x]])
        for p, q in _batches(steps[self.gram[act]], LIMIT):
            e = entry(act[p:q])
            posting = np.repeat(np.repeat(act[p:q], runs[self.gram[act[p:q]]]), length[e])
            yield self.piece[posting].astype(np.int64), _stretched(start[e], length[e]) - self.offset[posting]

    def _cells(self, posting: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, cell, places) of postings that meet runs of the text; a cell is `edits` diagonals, a band two cells."""
        piece, r = self.piece[posting], self.run[posting].astype(np.int64)
        step = np.maximum(1, self.edits[piece])
        low = start - self.offset[posting] - (r - 1) + PIECE
        many = (low + length + r - 2) // step - low // step + 1
        which = np.repeat(np.arange(len(posting)), many)
        cell = _stretched(low // step, many)
        if len(which) == len(posting) and (length == 1).all() and (r == 1).all():
            return piece, cell, np.ones(len(cell), np.int64)
        low, r, length, step = low[which], r[which], length[which], step[which]

        def below(x: np.ndarray) -> np.ndarray:
            """Pairs of places on diagonals under x: two boxes slid over each other."""
            t = x - low
            return _triangle(t) - _triangle(t - length) - _triangle(t - r) + _triangle(t - length - r)

        return piece[which], cell, below((cell + 1) * step) - below(cell * step)

    def _sparse(self, some: np.ndarray, runs: np.ndarray, first: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = runs[self.gram[some]]
        entry = _stretched(first[self.gram[some]], n)
        piece, cell, places = self._cells(np.repeat(some, n), start[entry], length[entry])
        key = piece.astype(np.int64) * width + cell
        key, places = np.concatenate([key, key - 1]), np.concatenate([places, places])  # each cell lies in two bands
        # most bands have a hit or two: a table of sums by hash drops them before the sort
        place = (key.astype(np.uint64) * MIX >> np.uint64(42)).astype(np.int64)
        full = np.bincount(place, places, minlength=1 << 22)[place] >= self.bound[np.minimum(key // width, len(self.size) - 1)]
        key, at = np.unique(key[full], return_inverse=True)
        piece = key // width
        keep = np.bincount(at, places[full], minlength=len(key)) >= self.bound[piece] if len(key) else np.zeros(0, bool)
        return piece[keep], key[keep] % width

    def _dense(self, some: np.ndarray, runs: np.ndarray, first: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of one piece with many places: sums of all its cells, a part of the places at a time."""
        piece = int(self.piece[some[0]])
        step = max(1, int(self.edits[piece]))
        sums = np.zeros(width // step + 3, np.int64)
        for x in some.tolist():
            f, n = int(first[self.gram[x]]), int(runs[self.gram[x]])
            for p, q in _batches(length[f : f + n] // step + int(self.run[x]) // step + 2, LIMIT):
                _, cell, places = self._cells(np.full(q - p, x), start[f + p : f + q], length[f + p : f + q])
                sums += np.bincount(cell, places, minlength=len(sums)).astype(np.int64)
        band = np.flatnonzero(sums + np.r_[sums[1:], 0] >= self.bound[piece])
        return np.full(len(band), piece), band


def aligned(pieces: np.ndarray, a: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each piece (a row) and a region of a on the diagonals of its band from low, and the region's end.

    One step for each byte of the pieces, one column for each diagonal of the band and of its margin.
    """
    n, m = pieces.shape
    width = 4 * most + 1 + 2 * (most == 0)
    start = low - most
    at = start[:, None] + np.arange(width + m)
    text = np.where((at >= 0) & (at < len(a)), a[np.clip(at, 0, max(0, len(a) - 1))], 0)
    t = np.arange(width, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)  # a region may begin anywhere
    row[:, -1] = 1 << 20
    for i in range(m):
        new = row[:, :-1] + (text[:, i : i + width] != pieces[:, i, None])
        np.minimum(new, row[:, 1:] + 1, out=new)
        new -= t
        np.minimum.accumulate(new, axis=1, out=new)
        row[:, :-1] = new + t
    row = row[:, :-1]
    best = row.argmin(axis=1)
    return row[np.arange(n), best], start + best + m


#: Bands that are aligned at once, and cells of bands that are counted at once.
BANDS, LIMIT = 4096, 1 << 20

_rng = np.random.default_rng(1)
_value = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_value[0] = 0  # like what lies beyond a text
_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


class Windows:
    """Digests of any stretches of a text, beyond its ends too, by sums over its prefixes."""

    def __init__(self, a: np.ndarray, margin: int):
        self.margin = margin
        full = np.concatenate([np.zeros(margin, np.uint8), a, np.zeros(margin, np.uint8)])
        power = np.cumprod(np.full(len(full), _BASE))
        self.sums = np.r_[np.uint64(0), np.cumsum(_value[full] * power)]
        self.back = np.cumprod(np.full(len(full) + 1, _BACK))

    def digests(self, start: np.ndarray, size: int) -> np.ndarray:
        s = np.clip(start + self.margin, 0, len(self.sums) - 1)
        e = np.clip(start + self.margin + size, 0, len(self.sums) - 1)
        return (self.sums[e] - self.sums[s]) * self.back[s]


def hits(index: Index, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, end, edits) of regions of a within the edit budget of a piece, the nearest one of each band, in batches.

    Bands of a piece with equal bytes below them are aligned once.
    """
    windows = None
    for piece, low in index.candidates(a):
        size, k = index.size[piece], index.edits[piece]
        order = np.lexsort((low, piece, k, size))
        cuts = np.flatnonzero((np.diff(size[order]) != 0) | (np.diff(k[order]) != 0)) + 1
        for some in np.split(order, cuts):
            most, m = int(k[some[0]]), int(size[some[0]])
            if windows is None:
                windows = Windows(a, 8 * PIECE)
            digest = windows.digests(low[some] - most, 4 * most + 3 + m)
            digest = (digest ^ piece[some].astype(np.uint64) * MIX) * MIX
            _, one, of = np.unique(digest, return_index=True, return_inverse=True)
            edits, after = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
            for s in range(0, len(one), BANDS):
                rows = some[one[s : s + BANDS]]
                rows_of = index.data[index.start[piece[rows]][:, None] + np.arange(m)]
                edits[s : s + BANDS], end = aligned(rows_of, a, low[rows], most)
                after[s : s + BANDS] = end - low[rows]
            edits, end = edits[of], low[some] + after[of]
            good = edits <= most
            yield piece[some][good], end[good], edits[good]


def runs(a: np.ndarray) -> list[np.ndarray]:
    """Of a normalised item of EXCERPT words or more: its runs of RUN words, or of their first PIECE bytes; those of fewer than LEAST bytes are too short to tell."""
    starts = np.r_[0, np.flatnonzero(a == 32) + 1]
    if len(starts) < EXCERPT:
        return []
    ends = np.r_[starts[1:] - 1, len(a)]
    cut = [a[starts[i] : min(ends[i + RUN - 1], starts[i] + PIECE)] for i in range(0, len(starts) - RUN + 1, EXCERPT - RUN + 1)]
    return [x for x in cut if len(x) >= LEAST]


def pieces_of(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """The different pieces of an item: overlapping ones, and runs of words that are searched verbatim (true)."""
    a = trimmed(text)
    if len(a) < LEAST:
        return
    starts = [*range(0, max(1, len(a) - PIECE), STRIDE)]
    if len(a) > PIECE:
        starts.append(len(a) - PIECE)
    yield from dict.fromkeys((a[s : s + PIECE].tobytes(), False) for s in starts)
    yield from dict.fromkeys((x.tobytes(), True) for x in runs(a))


def index_of(pieces: list[tuple[int, bytes, bool]]) -> Index:
    items: dict[tuple[bytes, bool], list[int]] = {}
    for item, x, verbatim in pieces:
        items.setdefault((x, verbatim), []).append(item)
    return Index(items)


def _search(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) of each region, in bytes of the text; begin is that of the straight diagonal.

    Hits of a piece whose ends are at most half its length apart are one region; the nearest of them, and of those the first, stands for it.
    """
    group, size = [], 0  # (text, bytes, places, bytes before)
    found: list[np.ndarray] = []  # text, piece, first and last end in normalised bytes, and of the nearest hit edits, end, begin and end in bytes
    gap = np.frombuffer(GAP, np.uint8)

    def regions(rows: np.ndarray) -> np.ndarray:
        """Rows of hits or regions joined where they follow each other closely."""
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.r_[True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)]
        last = rows[:, 3].copy()
        # the furthest end so far within a text and piece
        shift = np.cumsum(new) * (int(last.max()) + 1)
        last = np.maximum.accumulate(last + shift) - shift
        new[1:] |= rows[1:, 2] - last[:-1] > index.size[rows[1:, 1]] // 2
        region = np.cumsum(new) - 1
        nearest = np.lexsort((-rows[:, 6], rows[:, 5], rows[:, 4], region))
        nearest = nearest[np.r_[True, np.diff(region[nearest]) != 0]]
        out = rows[nearest].copy()
        out[:, 2] = rows[new, 2]
        out[:, 3] = np.maximum.reduceat(rows[:, 3], np.flatnonzero(new))
        return out

    def run() -> None:
        if not group:
            return
        starts = np.cumsum([0] + [len(g[1]) + len(gap) for g in group])
        a = np.concatenate([x for g in group for x in (g[1], gap)])
        text, before, length = (np.array(x, np.int64) for x in ([g[0] for g in group], [g[3] for g in group], [len(g[1]) for g in group]))
        places = np.concatenate([x for g in group for x in (g[2], np.zeros(len(gap), np.int64))])
        here = []
        for p, end, edits in hits(index, a):
            begin = end - index.size[p]
            j = np.searchsorted(starts, (begin + end) // 2, side="right") - 1
            j = np.clip(j, 0, len(group) - 1)
            b, e = np.maximum(0, begin - starts[j]), np.minimum(length[j], end - starts[j])
            ok = b < e
            p, j, b, e, edits = p[ok], j[ok], b[ok], e[ok], edits[ok]
            rows = np.stack([text[j], p, before[j] + e, before[j] + e, edits, before[j] + e, places[starts[j] + b], places[starts[j] + e - 1] + 1], axis=1)
            here.append(regions(rows))
        if here:
            found.append(regions(np.concatenate(here)))

    for t, data in enumerate(texts):
        for a, places, before in parts(data):
            group.append((t, a, places, before))
            size += len(a)
            if size >= PART:
                run()
                group.clear()
                size = 0
    run()
    if found:
        for t, p, _, _, edits, _, begin, end in regions(np.concatenate(found)).tolist():
            for item in index.items[p]:
                yield t, item, begin, end, edits


def pieces(benchmark: DataFrame) -> DataFrame:
    """item_id, piece (bytes) and verbatim of the items; each different one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                if i is not None and (some := list(pieces_of(text))):
                    piece, verbatim = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int64()), pa.array(piece, pa.binary()), pa.array(verbatim)], ["item_id", "piece", "verbatim"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, piece binary, verbatim boolean").distinct()


def blocks(cut: DataFrame, most: int = 0) -> Iterator[list[tuple[int, bytes, bool]]]:
    """The pieces in blocks of about `most` bytes, by hash; one block is on the driver at a time."""
    total = cut.agg(F.sum(F.octet_length("piece") + 8)).first()[0] or 0
    n = max(1, -(-total // (most or BLOCK_BYTES)))
    for i in range(n):
        rows = cut.where(F.pmod(F.xxhash64("item_id", "piece", "verbatim"), F.lit(n)) == i).collect()
        yield sorted((r["item_id"], bytes(r["piece"]), r["verbatim"]) for r in rows)


def found(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, n_regions (of pieces of the item), begin and end (bytes of the text, over all regions) and edits (of the nearest one)."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    cut = written(pieces(benchmark), "pieces")
    out = None
    for block in blocks(cut):
        index = index_of(block)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                regions = list(_search(index, list(text_bytes(b.column(1)))))
                if regions:
                    which, item, begin, end, edits = zip(*regions, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *(pa.array(x, pa.int64()) for x in (item, begin, end, edits))], ["key", "item_id", "begin", "end", "edits"])

        part = written(rows.mapInArrow(run, f"key {kind}, item_id long, begin long, end long, edits long"), "matches")
        out = part if out is None else out.unionAll(part)
    drop_written(cut)
    out = out.groupBy("key", "item_id").agg(F.count("*").alias("n_regions"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("edits").alias("edits"))
    return out.withColumnRenamed("key", key)


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a match, with all their columns; rows with a null key stay.

    The keys are written first: their size is known when the join is planned, and few of them need no exchange of the documents.
    """
    return documents.join(written(found(documents, benchmark, key, text).select(key).distinct(), "matched"), key, "left_anti")

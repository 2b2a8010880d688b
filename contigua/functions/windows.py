"""K-mers of batches of reads as numpy words: all windows of a batch at once, each from two halves.

Words are those of functions.packed: two bits a base, A, C, G, T as 0 to 3, the first base highest; beyond 32 bases hi has what precedes the last 32. Tasks hold
the reads of one part of a batch, PART bases of them or one read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, PART = 32, 1 << 21
U = np.uint64

_codes = np.zeros(256, np.uint8)
_codes[list(b"ACGT")] = range(4)
_base = np.zeros(256, bool)
_base[list(b"ACGT")] = True
#: The letters of four bases, by their byte.
_letters = np.frombuffer("".join(a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT").encode(), np.uint32)


def parts(batch: pa.RecordBatch, size: int = PART) -> Iterator[pa.RecordBatch]:
    """A batch, whose second column are texts, in parts of some `size` characters, one row at least."""
    if not batch.num_rows:
        return
    end = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = np.r_[0, np.flatnonzero(end[1:] != end[:-1]) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def lines(texts: pa.Array) -> np.ndarray:
    """The characters of all texts, a line end before, between and after them; a character is a byte."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    if data.max(initial=0) > 127:
        data = np.frombuffer(joined.to_pybytes().decode().encode("latin-1"), np.uint8)
    out = np.full(len(data) + 2, 10, np.uint8)
    out[1:-1] = data
    return out


def windows(codes: np.ndarray, n: int, turned: bool = False) -> np.ndarray:
    """The word of the n bases, 32 at most, from each place on; turned: of their reverse complement."""
    if len(codes) < n:
        return np.zeros(0, U)
    # of two neighbouring parts the first is the higher one, on the other strand the lower one
    join = lambda a, b, i, j: b << U(2 * i) | a if turned else a << U(2 * j) | b
    part, size = (U(3) - codes if turned else codes), 1
    out, have = None, 0
    while True:
        if n & size:
            if out is None:
                out = part
            else:
                m = len(codes) - have - size + 1
                out = join(out[:m], part[have : have + m], have, size)
            have += size
        if 2 * size > n:
            return out
        part = join(part[: len(part) - size], part[size:], size, size)
        size *= 2


@dataclass
class Kmers:
    """The k-mers of a text at each place, and their reverse complements; hi is None up to 32 bases."""

    hi: np.ndarray | None
    lo: np.ndarray
    back_hi: np.ndarray | None
    back_lo: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, k: int) -> Kmers:
        if k <= WORD:
            return cls(None, windows(codes, k), None, windows(codes, k, True))
        n, m = max(0, len(codes) - k + 1), k - WORD
        return cls(windows(codes, m)[:n], windows(codes, WORD)[m : m + n], windows(codes, m, True)[WORD : WORD + n], windows(codes, WORD, True)[:n])

    def canonical(self, at: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """hi, lo of the smaller strand of the k-mers at some places, and whether that is the other one."""
        a, b = self.lo[at], self.back_lo[at]
        if self.hi is None:
            flip = b < a
            return None, np.where(flip, b, a), flip
        c, d = self.hi[at], self.back_hi[at]
        flip = (d < c) | ((d == c) & (b < a))
        return np.where(flip, d, c), np.where(flip, b, a), flip


@dataclass
class Text:
    """Reads as one text: codes of bases (N and line ends are 0), which are no bases, and which qualities are good."""

    codes: np.ndarray
    no_base: np.ndarray
    good: np.ndarray

    @classmethod
    def of(cls, seq: pa.Array, qual: pa.Array, ones: np.ndarray) -> Text:
        text = lines(seq)
        return cls(_codes[text].astype(U), ~_base[text], ones[lines(qual)] & (text != 10))

    def clean(self, k: int) -> np.ndarray:
        """Whether the k characters from each place on are bases."""
        before = np.r_[0, np.cumsum(self.no_base)]
        return before[k:] == before[: max(0, len(before) - k)]


def words(seq: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in lines(seq) where k-mers without N begin, 32 bases at most, and these as words."""
    text = lines(seq)
    before = np.r_[0, np.cumsum(~_base[text])]
    at = np.flatnonzero(before[k:] == before[: max(0, len(before) - k)])
    return at, windows(_codes[text].astype(U), k)[at]


def good_table(ones: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in ones]] = True
    return out


def sided(codes: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """hi, lo, l and r of the canonical k-mers at some places with a good neighbour left or right; l and r are 1 to 4 for a good neighbour, else 0."""
    some = left | right
    at, left, right = at[some], left[some], right[some]
    hi, lo, flip = Kmers.of(codes, k).canonical(at)
    code = codes.astype(np.uint8)
    a, b = code[at - 1], code[at + k]
    l, r = np.where(left, a + 1, 0), np.where(right, b + 1, 0)
    # on the other strand sides swap and bases pair
    return hi, lo, np.where(flip, np.where(right, 4 - b, 0), l), np.where(flip, np.where(left, 4 - a, 0), r)


def occurrences(text: Text, k: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """sided() of all k-mers of a text."""
    at = np.flatnonzero(text.clean(k))
    return sided(text.codes, at, text.good[at - 1], text.good[at + k], k)


def good_places(text: Text, k: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The places of the k-mers of a text with a good neighbour left or right, and hi and lo of their canonical ones."""
    at = np.flatnonzero(text.clean(k))
    at = at[text.good[at - 1] | text.good[at + k]]
    hi, lo, _ = Kmers.of(text.codes, k).canonical(at)
    return at, hi, lo


def minimizers(codes: np.ndarray, k: int, size: int) -> np.ndarray:
    """The smallest hash of the parts of `size` bases, on either strand, of the k-mer at each place."""
    x = np.minimum(windows(codes, size), windows(codes, size, True))
    x = (x + U(1)) * U(0x9E3779B97F4A7C15)
    x = (x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)
    x, n, have = x ^ x >> U(32), k - size + 1, 1
    # the least of n in a row is that of two runs that overlap
    while have < n:
        by = min(have, n - have)
        x, have = np.minimum(x[: len(x) - by], x[by:]), have + by
    return x


def runs(text: Text, k: int, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, n and minimizer of the runs of `most` k-mers at most of one minimizer; where the words of each begin, these words, and flags of good neighbours left and right."""
    clean, least = text.clean(k), minimizers(text.codes, k, size)
    at = np.flatnonzero(clean)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(at))
    times = -(-n // most)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    n = np.minimum(np.repeat(n, times) - most * nth, most)
    at = at[np.repeat(first, times)] + most * nth
    # the base before, the run and the base after
    count = (n + k + 1) // WORD + 1
    begin = np.r_[0, np.cumsum(count)]
    j = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    pad = np.zeros(4 * WORD + k + most, U)
    words = windows(np.r_[text.codes, pad], WORD)[np.repeat(at - 1, count) + WORD * j]
    flags = np.r_[text.good.astype(U), pad]
    for by in (1, 2, 4, 8, 16, 32):
        flags = flags[:-by] << U(by) | flags[by:]
    return at, n, least[at], begin, words, flags[at - 1], flags[at + k]


def apart(n: np.ndarray, begin: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """sided() of the k-mers of runs."""
    codes = (words[:, None] >> np.arange(62, -2, -2).astype(U) & U(3)).ravel()
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flag = lambda x: (np.repeat(x, n) >> (63 - i).astype(U) & U(1)).astype(bool)
    return sided(codes, np.repeat(WORD * begin + 1, n) + i, flag(a), flag(b), k)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where equal keys begin, in sorted ones."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def order(word: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of words of `bits` bits.

    A word with its place below it sorts faster than places by words. Where both do not fit, the word's last bits go, and words that only these tell apart are sorted again.
    """
    low = len(word).bit_length()
    drop = max(0, bits + low - 64)
    key = word >> U(drop) << U(low) | np.arange(len(word), dtype=U)
    key.sort()
    out = (key & U((1 << low) - 1)).astype(np.int64)
    if drop:
        x = word[out]
        if (x[1:] < x[:-1]).any():
            out = out[np.argsort(x, kind="stable")]
    return out


#: A count of one of the neighbours l and r, in words of eight bytes, by 8 * l + r.
_one = np.zeros(64, np.uint64)
for _l in range(5):
    for _r in range(5):
        _one[8 * _l + _r] = sum(1 << 8 * (x - 1 + side) for x, side in ((_l, 0), (_r, 4)) if x)


def counted(hi: np.ndarray | None, lo: np.ndarray, l: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """hi and lo of the different k-mers, sorted, and a word of eight bytes that count their neighbours; a k-mer is there once for each 255 occurrences."""
    sides = l.astype(np.uint8) << 3 | r.astype(np.uint8)
    if 2 * k + 6 <= 64:
        word = lo << U(6) | sides.astype(U)
        word.sort()
        lo, sides = word >> U(6), word & U(63)
    else:
        at = order(lo, 2 * k) if hi is None else np.lexsort((lo, hi))
        hi, lo, sides = (x if x is None else x[at] for x in (hi, lo, sides))
    at = first_of_runs(*(x for x in (hi, lo) if x is not None))
    size = np.diff(at, append=len(lo))
    if size.max(initial=0) > 255:
        times = -(-size // 255)
        at = np.repeat(at, times) + 255 * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    n = np.add.reduceat(_one[sides], at) if len(at) else np.zeros(0, U)
    return None if hi is None else hi[at], lo[at], n


def sums(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts of words (rows x 8), added up in runs that begin at `at`."""
    if np.diff(at, append=len(words)).max(initial=0) > 257:
        each = words.view(np.uint8).reshape(-1, 8)
        return np.stack([np.add.reduceat(each[:, i], at, dtype=np.int64) for i in range(8)], axis=1)
    # up to 257 bytes add up to 16 bits, four of which a word holds
    out, word, mask = np.empty((len(at), 8), np.int64), words.view(U), U(0x00FF00FF00FF00FF)
    for side in range(2):
        out[:, side::2] = np.add.reduceat(word >> U(8 * side) & mask, at).view(np.uint16).reshape(-1, 4)
    return out


def _text(word: np.ndarray, n: int) -> np.ndarray:
    size = -(-n // 4)
    data = (word << U(8 * size - 2 * n)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]
    return _letters[data].view(np.uint8)[:, :n] if len(word) else np.zeros((0, n), np.uint8)


def spelled(hi: np.ndarray | None, lo: np.ndarray, k: int) -> pa.Array:
    """K-mers as strings."""
    text = _text(lo, k) if k <= WORD else np.concatenate([_text(hi, k - WORD), _text(lo, WORD)], axis=1)
    at = np.arange(len(lo) + 1, dtype=np.int64) * k
    return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.string())

"""K-mers of up to 64 bases as two BIGINTs, cut, turned and compared by native shifts.

Two bits a base, A, C, G, T as 0 to 3, the first base highest. lo has the last 32 bases of a k-mer and hi those before; up to 32 bases hi is 0.
A text is an array of pieces of 32 bases (or of 64 flags), the first one highest, from which any window is two shifts. So a k-mer costs
a few integer operations and no string, and shuffles and groups by eight or sixteen bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32
LONGEST = 2 * WORD


def _long(x: int) -> Column:
    """A literal of 64 bits."""
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n) if isinstance(n, int) else n)


def _right(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(n) if isinstance(n, int) else n)


def _cut(digits: Column, size: int, base: int) -> Column:
    """The array of 64-bit pieces of a string of digits."""
    piece = lambda j: F.conv(F.rpad(F.substr(digits, j * size + 1, F.lit(size)), size, "0"), base, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / size).cast("int")), piece)


def pieces(seq: Column) -> Column:
    """A sequence of A, C, G, T and N, which reads as A, in pieces of 32 bases."""
    return _cut(F.translate(seq, "ACGTN", "01230"), WORD, 4)


def flags(text: Column, ones: str, zeros: str) -> Column:
    """Which characters of a text are among `ones`, in pieces of 64 flags; all others are among `zeros`."""
    return _cut(F.translate(text, ones + zeros, "1" * len(ones) + "0" * len(zeros)), 2 * WORD, 2)


def _slid(of: Column, at: Column, bits: int) -> Column:
    """64 bits from the item `at` on, of pieces of items of `bits` bits; nothing follows the last piece."""
    size = 64 // bits
    j, by = F.shiftright(at, size.bit_length() - 1), at.bitwiseAND(F.lit(size - 1)) * bits
    zero = _long(0)
    here, after = F.coalesce(F.get(of, j), zero), F.coalesce(F.get(of, j + 1), zero)
    # a shift by 64 would be none, so the second one is taken in two steps
    return _left(here, by).bitwiseOR(_right(_right(after, 1), F.lit(63) - by))


def bases(of: Column, at: Column, n: int) -> Column:
    """n bases, 32 at most, from place `at` of some pieces, as one number."""
    found = _slid(of, at, 2)
    return found if n == WORD else _right(found, 64 - 2 * n)


def flag_word(of: Column, at: Column) -> Column:
    """64 flags from place `at` on, the first one highest."""
    return _slid(of, at, 1)


def flag(word: Column, i: Column) -> Column:
    """Flag i, from 0, of a word."""
    return _left(word, i) < 0


@dataclass(frozen=True)
class Kmer:
    """A k-mer as two columns."""

    hi: Column
    lo: Column
    k: int

    def __lt__(self, other: Kmer) -> Column:
        """As strings compare; words with all 64 bits in use compare unsigned."""
        a, b = ((x.lo.bitwiseXOR(_long(1 << 63)) if self.k >= WORD else x.lo) for x in (self, other))
        if self.k <= WORD:
            return a < b
        c, d = ((x.hi.bitwiseXOR(_long(1 << 63)) if self.k == LONGEST else x.hi) for x in (self, other))
        return (c < d) | (c == d) & (a < b)

    def revcomp(self) -> Kmer:
        k = self.k
        if k <= WORD:
            return Kmer(self.hi, _right(turned(self.lo), 64 - 2 * k) if k < WORD else turned(self.lo), k)
        first, n = turned(self.lo), k - WORD
        last = turned(self.hi) if n == WORD else _right(turned(self.hi), 64 - 2 * n)
        if n == WORD:
            return Kmer(first, last, k)
        return Kmer(_right(first, 64 - 2 * n), _left(first, 2 * n).bitwiseOR(last), k)

    def text(self) -> Column:
        digits = lambda x, n: F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), n, "0"), "0123", "ACGT")
        return digits(self.lo, self.k) if self.k <= WORD else F.concat(digits(self.hi, self.k - WORD), digits(self.lo, WORD))


def turned(x: Column) -> Column:
    """The reverse complement of the 32 bases of a word."""
    x = F.bitwise_not(x)
    for by, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = _right(x, by).bitwiseAND(_long(mask)).bitwiseOR(_left(x.bitwiseAND(_long(mask)), by))
    return _right(x, 32).bitwiseOR(_left(x, 32))


def check(k: int) -> None:
    if not 0 < k <= LONGEST:
        raise ValueError(f"packed k-mers have 1 to {LONGEST} bases")


def kmer_at(of: Column, at: Column, k: int) -> Kmer:
    """The k-mer at a place of some pieces."""
    check(k)
    if k <= WORD:
        return Kmer(_long(0), bases(of, at, k), k)
    return Kmer(bases(of, at, k - WORD), bases(of, at + (k - WORD), WORD), k)


def from_text(kmer: Column | str, k: int) -> Kmer:
    """A k-mer given as a string."""
    check(k)
    digits = F.translate(F.col(kmer) if isinstance(kmer, str) else kmer, "ACGT", "0123")
    number = lambda d: F.conv(d, 4, -10).cast("long")
    if k <= WORD:
        return Kmer(_long(0), number(digits), k)
    return Kmer(number(F.substring(digits, 1, k - WORD)), number(F.substring(digits, k - WORD + 1, WORD)), k)

"""Column functions over DNA strings; bases order as A < C < G < T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
PAIRED = "TGCA"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(c: Column | str) -> Column:
    return F.translate(_col(c), BASES, PAIRED)


def revcomp(c: Column | str) -> Column:
    return F.reverse(complement(c))


def canonical(c: Column | str) -> Column:
    return F.least(_col(c), revcomp(c))


def is_canonical(c: Column | str) -> Column:
    return _col(c) <= revcomp(c)


def base_code(c: Column | str) -> Column:
    """0 to 3 for A, C, G, T; N counts as A; null for anything else."""
    at = F.instr(F.lit(BASES), F.translate(_col(c), "N", "A"))
    return F.when((F.length(_col(c)) == 1) & (at > 0), at - 1).cast("tinyint")


def code_base(c: Column | str) -> Column:
    return F.substring(F.lit(BASES), _col(c).cast("int") + 1, 1)


def inverse_code(c: Column | str) -> Column:
    return (3 - _col(c)).cast("tinyint")


def base_at(kmer: Column | str, i: int) -> Column:
    """The base at place i, from 0."""
    return F.substring(_col(kmer), i + 1, 1)


def with_base(kmer: Column | str, i: int, base: Column | str) -> Column:
    return F.overlay(_col(kmer), base if isinstance(base, Column) else F.lit(base), F.lit(i + 1), F.lit(1))


def packed_size(k: int) -> int:
    """Bytes of a k-mer at two bits a base."""
    return -(-k // 4)


def occurrence_size(k: int) -> int:
    """Bytes of a k-mer with two neighbours and their qualities."""
    return 3 + packed_size(k)


def compare(a: Column | str, b: Column | str, length: int, a_from: int = 0, b_from: int = 0) -> Column:
    """-1, 0 or 1 as the `length` bases of a from a_from order before, like or after those of b."""
    x, y = (F.substring(_col(c), at + 1, length) for c, at in ((a, a_from), (b, b_from)))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def matches_at(kmer: Column | str, text: Column | str, at: int = 0) -> Column:
    t = text if isinstance(text, Column) else F.lit(text)
    return F.substr(_col(kmer), F.lit(at + 1), F.length(t)) == t


def matches_or_revcomp(kmer: Column | str, text: Column | str) -> Column:
    t = text if isinstance(text, Column) else F.lit(text)
    return (_col(kmer) == t) | (_col(kmer) == revcomp(t))


def contains(seq: Column | str, text: Column | str) -> Column:
    t = text if isinstance(text, Column) else F.lit(text)
    return F.instr(_col(seq), t) > 0


def contains_or_revcomp(seq: Column | str, text: Column | str) -> Column:
    t = text if isinstance(text, Column) else F.lit(text)
    return contains(seq, t) | contains(seq, revcomp(t))


def is_dna(c: Column | str, with_n: bool = False) -> Column:
    return _col(c).rlike("^[ACGTN]*$" if with_n else "^[ACGT]*$")


def checked(c: Column | str, ok: Column, what: str) -> Column:
    """c where ok holds; the query fails elsewhere."""
    return F.when(ok, _col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(_col(c).cast("string"), F.lit("null")))))

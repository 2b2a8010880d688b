"""Extension counts to the table of k-mers with unique extensions (UFX)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import dna, packed
from contigua.operators import kmers, superkmers


def masks(counts: DataFrame, cfg: Config) -> DataFrame:
    """kmer, lmask, rmask: bit i is set if base i occurs d_min times or more on that side."""
    mask = lambda side: reduce(add, (F.when(F.col(side + b) >= cfg.d_min, 1 << i).otherwise(0) for i, b in enumerate(dna.BASES)))
    return counts.select("kmer", mask("l").cast("tinyint").alias("lmask"), mask("r").cast("tinyint").alias("rmask"))


def valid(table: DataFrame) -> DataFrame:
    """k-mers with a valid base on either side."""
    return table.where("lmask > 0 or rmask > 0")


def is_unique(mask: Column | str) -> Column:
    return F.bit_count(mask) == 1


def unique_both(table: DataFrame) -> DataFrame:
    """k-mers with one valid base on each side."""
    return table.where(is_unique("lmask") & is_unique("rmask"))


def unique_base(mask: Column | str) -> Column:
    """The base of a mask of one bit; null for others."""
    m = F.col(mask) if isinstance(mask, str) else mask
    out = F.when(m == 1, dna.BASES[0])
    for i, b in enumerate(dna.BASES[1:], 1):
        out = out.when(m == 1 << i, b)
    return out


def letter(mask: Column | str) -> Column:
    """X for none, the base if it is the only one, F for several."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.when(m == 0, "X").otherwise(F.coalesce(unique_base(m), F.lit("F")))


def with_letters(table: DataFrame) -> DataFrame:
    return table.select("kmer", letter("lmask").alias("lext"), letter("rmask").alias("rext"))


def both_strands(lettered: DataFrame) -> DataFrame:
    """Each row and that of its reverse complement, with sides swapped and paired; a k-mer that is its own reverse complement is there once."""
    rc = lettered.select(dna.revcomp("kmer").alias("_rc"), "kmer", dna.complement("rext").alias("lext"), dna.complement("lext").alias("rext"))
    return lettered.select("kmer", "lext", "rext").unionAll(rc.where("_rc <> kmer").select(F.col("_rc").alias("kmer"), "lext", "rext"))


def mask_of(ext: Column | str) -> Column:
    """The mask of a letter; F and X are lost to 0, as neither is one base."""
    e = F.col(ext) if isinstance(ext, str) else ext
    out = F.when(e == dna.BASES[0], 1)
    for i, b in enumerate(dna.BASES[1:], 1):
        out = out.when(e == b, 1 << i)
    return out.otherwise(0).cast("tinyint")


def from_letters(lettered: DataFrame) -> DataFrame:
    """kmer, lmask, rmask of the canonical rows, each once."""
    rows = lettered.where(dna.is_canonical("kmer")).groupBy("kmer").agg(F.max(F.struct("lext", "rext")).alias("e"))
    return rows.select("kmer", mask_of("e.lext").alias("lmask"), mask_of("e.rext").alias("rmask"))


def ufx_table(reads: DataFrame, cfg: Config) -> DataFrame:
    """kmer, lmask, rmask of all k-mers of the reads with a valid extension; k-mers of up to 64 bases are counted packed."""
    if cfg.k <= packed.LONGEST:
        return superkmers.valid_masks(reads, cfg)
    found = kmers.canonicalised(kmers.good_quality(kmers.extract(reads, cfg, strands=True), cfg))
    return valid(masks(kmers.extension_counts(found, cfg), cfg))

"""UFX tables and contigs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.operators import contigs as C
from contigua.operators import ufx


def write_ufx(table: DataFrame, path: str) -> None:
    """Two rows for each k-mer of (kmer, lmask, rmask): k-mer, tab, left and right letter, for both strands."""
    rows = ufx.both_strands(ufx.with_letters(table))
    rows.select("kmer", F.concat("lext", "rext").alias("exts")).write.csv(path, sep="\t")


def read_ufx(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, lmask, rmask) from such files; F and X, which are not one base, are an empty side."""
    rows = spark.read.csv(path, sep="\t", schema="kmer string, exts string")
    return ufx.from_letters(rows.select("kmer", F.substring("exts", 1, 1).alias("lext"), F.substring("exts", 2, 1).alias("rext")))


def write_fasta(found: DataFrame, path: str, cfg: Config, one_file: bool = False) -> None:
    """Contigs with ids as FASTA; the files of the folder follow each other in the order of ids."""
    rows = C.fasta(found, cfg)
    rows = rows.coalesce(1).sortWithinPartitions("contig_id") if one_file else rows.repartitionByRange("contig_id").sortWithinPartitions("contig_id")
    rows.select("value").write.text(path)


def write_sequences(found: DataFrame, path: str) -> None:
    """The sequences alone, one in a line."""
    found.select("seq").write.text(path)


def write_lengths(found: DataFrame, path: str) -> None:
    found.select(F.length("seq").cast("string")).write.text(path)

"""A table of extension counts that grows with new reads.

Counts are kept in files bucketed and sorted by k-mer. Those of new reads are counted alone, dealt to the same buckets, and joined with the stored ones
bucket by bucket, so the stored table, however large, is read and merged where it lies: only the new counts are exchanged. Each merge writes a new table
beside the old one, which stays as it is until it is dropped; a merge that is interrupted leaves the old one untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.operators import kmers, superkmers
from contigua.operators.storage import written

BUCKETS = 64
#: k-mers of a bucket, which a task sorts and merges.
BUCKET = 1 << 21
SCHEMA = "kmer STRING, " + ", ".join(f"{c} BIGINT" for c in kmers.COUNTS)


def _name() -> str:
    return f"counts_{uuid.uuid4().hex}"


def buckets_for(counts: DataFrame, least: int = 1) -> int:
    """So many buckets that none has many more than BUCKET of the k-mers of counts."""
    return max(least, -(-counts.count() // BUCKET))


def store(counts: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes counts (kmer, COUNTS) to a fresh path, bucketed, and opens them."""
    name = _name()
    dealt = counts.select("kmer", *kmers.COUNTS).repartition(buckets, "kmer")
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(name)
    return counts.sparkSession.table(name)


def opened(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The counts that store() or merge() left at a path, also one of another session; the number of buckets is that of then."""
    name = _name()
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS")
    return spark.table(name)


def merged(stored: DataFrame, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The sums of stored and of new counts; new ones alone are exchanged."""
    added = new.select("kmer", *(F.col(c).alias(f"_{c}") for c in kmers.COUNTS)).repartition(buckets, "kmer")
    both = stored.hint("merge").join(added, "kmer", "full_outer")
    zero = F.lit(0).cast("long")
    return both.select("kmer", *((F.coalesce(c, zero) + F.coalesce(f"_{c}", zero)).alias(c) for c in kmers.COUNTS))


def grow(stored: DataFrame, reads: DataFrame, path: str, cfg: Config, buckets: int = BUCKETS) -> DataFrame:
    """Adds reads to stored counts; the sums are at `path`, in the same buckets."""
    new = written(superkmers.extension_counts(reads, cfg), "counts")
    name = _name()
    merged(stored, new, buckets).write.format("parquet").option("path", path).bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(name)
    return stored.sparkSession.table(name)

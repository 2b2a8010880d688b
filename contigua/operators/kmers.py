"""Reads to k-mer occurrences to extension counts.

Reads: read_id, seq, qual (strings). Occurrences: read_id, pos, kmer, l, lq, r, rq: the bases and qualities left and right of the
k-mer, null and 0 at the ends of a read. All steps are built-in expressions; the only shuffle is that of the counts, after
partial aggregation, so frequent k-mers do not make large tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import dna

SIDES = ("l", "r")
COUNTS = [side + b for side in SIDES for b in dna.BASES]


def quality(char: Column, cfg: Config) -> Column:
    """The number of a quality character."""
    q = F.ascii(char) - cfg.quality_offset
    if cfg.wrap_quality:
        return q.bitwiseAND(255).cast("smallint")
    return F.when(q >= 0, q).otherwise(F.raise_error(F.lit("a quality is below the offset"))).cast("smallint")


def decoded_qualities(reads: DataFrame, cfg: Config) -> DataFrame:
    """reads with quals, the array of their qualities."""
    return reads.withColumn("quals", F.transform(F.split(F.col("qual"), ""), lambda c: quality(c, cfg)))


def checked_reads(reads: DataFrame, cfg: Config) -> DataFrame:
    """Reads of ACGTN only: others fail the query (FAILFAST) or are left out (DROP)."""
    ok = dna.is_dna("seq", with_n=True) & (F.length("seq") == F.length("qual"))
    if cfg.mode == "DROP":
        return reads.where(ok)
    return reads.withColumn("seq", dna.checked("seq", ok, "not a read of A, C, G, T and N with as many qualities"))


def windows(reads: DataFrame, k: int, strands: bool = False) -> DataFrame:
    """read_id, seq, qual, pos (from 0) and kmer of each window; reads shorter than k have none.

    With strands also rc, its reverse complement, cut out of the read's, which is made once for a read and not for each k-mer.
    """
    rows = reads.withColumn("_rc", dna.revcomp("seq")) if strands else reads
    # the condition comes first, as sequence() would count downwards
    at = rows.where(F.length("seq") >= k).select("read_id", "seq", "qual", *["_rc"] * strands, F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos"))
    at = at.withColumn("kmer", F.substr("seq", F.col("pos") + 1, F.lit(k)))
    return at.withColumn("rc", F.substr("_rc", F.length("seq") - F.col("pos") - k + 1, F.lit(k))).drop("_rc") if strands else at


def without_n(occurrences: DataFrame) -> DataFrame:
    return occurrences.where(F.instr("kmer", "N") == 0)


def with_neighbours(found: DataFrame, cfg: Config) -> DataFrame:
    """Occurrences from windows; a neighbour N reads as A."""
    one = F.lit(1)
    left, right = F.col("pos"), F.col("pos") + cfg.k + 1
    has_left, has_right = F.col("pos") > 0, F.col("pos") + cfg.k < F.length("seq")
    base = lambda at: F.translate(F.substr("seq", at, one), "N", "A")
    q = lambda at: quality(F.substr("qual", at, one), cfg)
    zero = F.lit(0).cast("smallint")
    return found.select(
        "read_id",
        "pos",
        "kmer",
        F.when(has_left, base(left)).alias("l"),
        F.when(has_left, q(left)).otherwise(zero).alias("lq"),
        F.when(has_right, base(right)).alias("r"),
        F.when(has_right, q(right)).otherwise(zero).alias("rq"),
        *(c for c in ("rc",) if c in found.columns),
    )


def extract(reads: DataFrame, cfg: Config, strands: bool = False) -> DataFrame:
    """All occurrences of k-mers without N; with strands also rc, their reverse complements, which spare canonicalised() making them."""
    return with_neighbours(without_n(windows(checked_reads(reads, cfg), cfg.k, strands)), cfg)


def good_quality(occurrences: DataFrame, cfg: Config) -> DataFrame:
    """Occurrences with a neighbour of good quality on either side."""
    return occurrences.where((F.col("lq") > cfg.q_min) | (F.col("rq") > cfg.q_min))


def canonicalised(occurrences: DataFrame) -> DataFrame:
    """The smaller of each k-mer and its reverse complement; on a change the sides swap and pair."""
    rc = F.col("rc") if "rc" in occurrences.columns else dna.revcomp("kmer")
    rows = occurrences.withColumn("_rc", rc).withColumn("_flip", F.col("_rc") < F.col("kmer"))
    pick = lambda yes, no: F.when(F.col("_flip"), yes).otherwise(no)
    return rows.select(
        "read_id",
        "pos",
        F.least("kmer", "_rc").alias("kmer"),
        pick(dna.complement("r"), F.col("l")).alias("l"),
        pick(F.col("rq"), F.col("lq")).alias("lq"),
        pick(dna.complement("l"), F.col("r")).alias("r"),
        pick(F.col("lq"), F.col("rq")).alias("rq"),
    )


def without_first(occurrences: DataFrame) -> DataFrame:
    """All but the first occurrence, by (read_id, pos), of each k-mer: what an exact seen-before filter lets through.

    The first place is an aggregate and the join is on the k-mer, so no k-mer's occurrences have to be sorted in one task.
    """
    first = occurrences.groupBy("kmer").agg(F.min(F.struct("read_id", "pos")).alias("first"))
    return occurrences.join(first, "kmer").where(F.struct("read_id", "pos") != F.col("first")).drop("first")


def extension_counts(occurrences: DataFrame, cfg: Config) -> DataFrame:
    """kmer and the number of good neighbours of each base on each side, as bigints that do not wrap."""
    one = lambda side, b: F.count(F.when((F.col(side) == b) & (F.col(side + "q") > cfg.q_min), 1))
    return occurrences.groupBy("kmer").agg(*(one(side, b).alias(side + b) for side in SIDES for b in dna.BASES))


def spectrum(occurrences: DataFrame) -> DataFrame:
    """How many k-mers occur how often."""
    return occurrences.groupBy("kmer").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("kmers"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """row_number over everything by a range exchange: no task sees more than its range. Adds n, from 1."""
    from contigua.operators.storage import written

    place = F.monotonically_increasing_id()
    part = F.shiftrightunsigned(F.col("_id"), 33)
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", place), "numbered")
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    # one row for each partition, not for each row
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offset = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part").withColumn("n", F.col("before") + offset + 1).drop("part", "before", "_id")

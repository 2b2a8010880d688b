"""Paths that are contracted in rounds: those of pointer doubling, and what is exchanged for them."""

import random

import pytest
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.operators import compaction
from contigua.operators import contigs as C
from contigua.operators import superkmers
from contigua.operators import ufx as U
from contigua.operators.storage import written
from tests.test_engine import as_reads
from tests.test_packed import graphs

SIZES = ((30, 60, 40), (5, 9, 1 << 16))


@pytest.fixture(autouse=True)
def small_batches(spark):
    # a block has one batch at least
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def with_sizes(monkeypatch, sizes):
    for name, n in zip(("BLOCK", "LARGE", "LONGEST"), sizes, strict=True):
        monkeypatch.setattr(compaction, name, n)


@pytest.mark.parametrize("name, k, seqs", [g for g in graphs() if g[1] % 2 and g[0] in ("branches", "circles and a line")])
def test_contracted_paths_are_those_of_doubling(spark, monkeypatch, name, k, seqs):
    table = written(U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=k)), "ufx")
    expected = rows(C.contigs_of_pieces(table, None, k))
    for sizes in SIZES:
        with_sizes(monkeypatch, sizes)
        assert rows(C.contigs(table, k=k)) == expected


def test_paths_within_bins_are_those_of_doubling(spark, monkeypatch):
    # a circle, a palindrome that turns back, and a line
    seqs = [s * 2 for s in ("ACGTTGCAAGGCTATTC", "TTGACGATCGTCAAGG")] * 2 + ["GATTACAGGCATCCAGTTGCAACTGGAT"] * 3
    table = written(U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=7)), "ufx")
    for bin_of, bins in ((F.ascii(F.substring("least", 2, 1)), 2), (F.lit(0), 1)):
        expected = rows(C._local_by_nodes(C.oriented_nodes(table), bin_of, bins))
        with_sizes(monkeypatch, SIZES[1])
        assert expected and rows(C.local_contigs(table, bin_of, bins, 7)) == expected


def test_a_path_that_is_whole_is_exchanged_no_more(spark, monkeypatch):
    """each node is exchanged once, or twice at the border of two blocks; then rounds have shared ends only, and leave no path behind."""
    rng = random.Random(3)
    cfg = Config(q_min=19, d_min=2, k=15)
    table = written(superkmers.unique_words(as_reads(spark, ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(100)] * 3), cfg), "words")
    with_sizes(monkeypatch, (50, 1 << 22, 1 << 16))
    nodes = table.count()
    dealt = compaction._dealt(compaction.words(table, 15), 15)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert nodes < dealt.count() < 1.4 * nodes
    scratch = []
    whole, rest = compaction.contracted(compaction.words(table, 15), 15, scratch)
    assert whole.count() == 100 and rest.count() == 0
    sizes = [p.count() for p in scratch]
    assert len(sizes) > 2 and sum(sizes[1:]) < 2 * sizes[0] and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


def test_ends_in_other_bins_are_exchanged_once(spark):
    """a node whose neighbours are of other bins needs no block but one."""
    table = written(U.ufx_table(as_reads(spark, ["ACGTTGCAAGGCTATTCCGATGACCTG"] * 3), Config(q_min=19, d_min=2, k=15)), "ufx")
    alone = compaction.within_bins(table, 15, F.crc32("least"))
    assert alone.where("cut <> 3").isEmpty() and compaction._dealt(alone, 15).count() == alone.count() > 0


def test_ids_exchange_rows_once(spark):
    """the rows before each range are broadcast, so rows are not exchanged again."""
    from contigua.operators import kmers

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = kmers.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("x")), F.col("x"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert rows(found.select("x", "n")) == [(i, i + 1) for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_of_whole_contigs_are_not_joined(spark):
    """contigs that compaction makes whole are cut to chunks as they are."""
    from contigua.operators import bidirected as B

    rng = random.Random(8)
    cfg = Config(q_min=19, d_min=2, k=15)
    words = written(superkmers.unique_words(as_reads(spark, ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(30)] * 3), cfg), "words")
    found = B.named_chunks(words, size=20, k=15)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") <= 1
    expected = rows(C.contigs_of_pieces(words, None, 15))
    assert len(expected) >= 30 and rows(C.contigs(words, k=15)) == rows(B.whole_contigs(words, k=15)) == expected
    ids = C.with_ids(C.contigs(words, k=15)).collect()
    assert rows(found) == sorted((r.contig_id, r.len, r.left_ext, r.right_ext, c, r.seq[20 * c : 20 * c + 20]) for r in ids for c in range(-(-r.len // 20)))

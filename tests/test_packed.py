"""Packed k-mers, super-k-mers, sketches, the bidirected graph and chunks of contigs."""

import random

import pytest
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import packed
from contigua.operators import bidirected as B
from contigua.operators import contigs as C
from contigua.operators import kmers as K
from contigua.operators import sketch, superkmers
from contigua.operators import ufx as U
from tests.test_engine import as_reads, revcomp, tiled


@pytest.mark.parametrize("k", [1, 5, 31, 32, 33, 47, 63, 64])
def test_words_like_strings(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(30)] + [b * k for b in "ACGT"] + ["T" * (k - 1) + "A"]
    x = packed.from_text("s", k)
    y = x.revcomp()
    cut = packed.kmer_at(packed.pieces(F.concat(F.repeat(F.lit("GA"), 17), "s", F.lit("N"))), F.lit(34), k)
    for r in spark.createDataFrame([(s,) for s in texts], "s string").select("s", x.text().alias("t"), y.text().alias("r"), (y < x).alias("lt"), (x < x).alias("same"), cut.text().alias("w")).collect():
        assert r.t == r.s == r.w and r.r == revcomp(r.s) and r.lt == (revcomp(r.s) < r.s) and not r.same
    with pytest.raises(ValueError, match="64"):
        packed.check(65)


def odd_reads(spark, n=60):
    rng = random.Random(n)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    rows = []
    for i in range(n):
        s = list(genome[(at := rng.randrange(250)) : at + rng.randrange(5, 50)])
        if i % 7 == 0:
            s[rng.randrange(len(s))] = "N"
        s = "".join(s)
        rows.append((f"r{i}", revcomp(s) if i % 2 and "N" not in s else s, "".join(rng.choice("hhhTSB\x7f@") for _ in s)))
    rows += [("a", "A" * 200, "h" * 200), ("n", "N" * 40, "h" * 40), ("e", "", ""), ("p", "ACGT" * 20, "h" * 80)]
    return spark.createDataFrame(rows, "read_id string, seq string, qual string").repartition(3)


@pytest.mark.parametrize("k", [4, 13, 32, 35])
def test_packed_counts(spark, k):
    cfg = Config(q_min=19, d_min=2, k=k)
    reads = odd_reads(spark)
    expected = sorted(tuple(r) for r in K.extension_counts(K.canonicalised(K.good_quality(K.extract(reads, cfg), cfg)), cfg).collect())
    found = superkmers.extension_counts(reads, cfg)
    assert found.columns == ["kmer", *K.COUNTS] and sorted(tuple(r) for r in found.collect()) == expected
    # few minimizers are hot, all are, none is
    for share in (4, 1 << 20, 1):
        assert sorted(tuple(r) for r in superkmers.extension_counts_by_runs(reads, cfg, size=5, share=share).collect()) == expected


def test_runs_need_one_exchange_and_qualities_below_the_offset_fail(spark):
    cfg = Config(q_min=19, d_min=2, k=13)
    runs = superkmers.super_kmers(odd_reads(spark), cfg)
    assert max(r["n"] for r in runs.collect()) <= superkmers.RUN
    counts = superkmers.extension_counts_by_runs(as_reads(spark, ["ACGTTGCATGCCATG"]), cfg, share=1)
    assert counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="below the offset"):
        superkmers.extension_counts(spark.createDataFrame([("r", "ACGTACGTACGTACGT", "0" * 16)], "read_id string, seq string, qual string"), Config(k=5, wrap_quality=False)).collect()


def test_single_kmers_leave_before_the_exchange(spark):
    cfg = Config(q_min=19, d_min=2, k=13)
    found = K.canonicalised(K.good_quality(K.extract(odd_reads(spark), cfg), cfg)).cache()
    expected = sorted(tuple(r) for r in K.without_first(found).select(*found.columns).collect())
    n, single = found.count(), found.groupBy("kmer").count().where("count = 1").count()
    assert single > 20
    for slots in (64, 1 << 10, 1 << 20):
        assert sorted(tuple(r) for r in sketch.repeated_occurrences(found, slots).select(*found.columns).collect()) == expected
    assert sketch.without_single(found, 1 << 20).count() <= n - single + 2
    assert sketch.repeated_occurrences(found.limit(0), 64).count() == 0
    with pytest.raises(ValueError, match="64"):
        sketch.repeated(found, 100)


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def graphs():
    rng = random.Random(3)
    x = genome(rng, 50)
    yield "line", 21, tiled(genome(rng, 300), 21, 40)
    yield "circle", 21, tiled(genome(rng, 200), 21, 40, True)
    yield "hairpin", 21, tiled(x + revcomp(x), 21, 40)
    yield "homopolymer", 21, ["A" * 60] * 4
    yield "circles and a line", 21, tiled(genome(rng, 120), 21, 40, True) + tiled(genome(rng, 150), 21, 40, True) + tiled(genome(rng, 90), 21, 40)
    yield "circle of a strand and its mirror", 21, (lambda a: tiled(a + revcomp(a), 21, 40, True))(genome(rng, 80))
    yield "branches", 7, tiled(genome(rng, 400), 7, 20)
    yield "nothing", 21, []


@pytest.mark.parametrize("name, k, seqs", list(graphs()))
def test_bidirected_contigs(spark, name, k, seqs):
    table = U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=k)).cache()
    expected = sorted(tuple(r) for r in C.contigs(table).collect())
    assert B.nodes(table).count() * 2 == C.oriented_nodes(table).count()
    for sizes in ({"size": 50}, {"size": 1000, "minimizer_size": 3, "block": 7}):
        ids, chunks = B.contig_chunks(table, **sizes)
        assert sorted(tuple(r) for r in B.whole(ids, chunks).collect()) == expected
        named = sorted((r["contig_id"], r["len"]) for r in ids.collect())
        assert [i for i, _ in named] == list(range(1, len(expected) + 1)) and [n for _, n in named] == sorted((n for _, n in named), reverse=True)
        assert all(len(r["bases"]) <= sizes["size"] for r in chunks.collect())


def test_even_k_has_each_kmer_in_one_contig(spark):
    rng = random.Random(12)
    k = 8
    table = U.ufx_table(as_reads(spark, tiled(genome(rng, 30) + "ACGTACGT" + genome(rng, 30) + "GGAATTCC" + genome(rng, 40), k, 20)), Config(q_min=19, d_min=2, k=k)).cache()
    seqs = [r["seq"] for r in B.whole(*B.contig_chunks(table, size=16)).collect()]
    found = sorted(min(s[i : i + k], revcomp(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1))
    unique = [r["kmer"] for r in U.unique_both(table).collect()]
    assert found == sorted(x for x in unique if x != revcomp(x)) and len(found) < len(unique)


def test_equal_first_chunks_are_told_apart(spark):
    rng = random.Random(7)
    # two contigs of one length: ids go by the whole sequences, also where chunks are a few bases
    seqs = tiled(genome(rng, 90), 21, 40) + tiled(genome(rng, 90), 21, 40) + tiled(genome(rng, 90), 21, 40)
    table = U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=21)).cache()
    expected = [tuple(r) for r in C.with_ids(C.contigs(table)).orderBy("contig_id").collect()]
    for size in (1, 2, 64):
        ids, chunks = B.contig_chunks(table, size=size)
        whole = ids.join(chunks.groupBy("contig_id").agg(C._in_order("chunk", "bases").alias("seq")), "contig_id")
        assert [tuple(r) for r in whole.select("contig_id", "seq", "left_ext", "right_ext", "len").orderBy("contig_id").collect()] == expected


def test_fasta_lines_do_not_cross_chunks(spark):
    cfg = Config(q_min=19, d_min=2, k=21, fasta_textwidth=7)
    table = U.ufx_table(as_reads(spark, tiled(genome(random.Random(1), 200), 21, 40)), cfg).cache()
    size = B.chunk_size(cfg, 40)
    assert size == 35 and B.chunk_size(cfg, 3) == 7
    whole = "".join(r["value"] + "\n" for r in C.fasta(C.with_ids(C.contigs(table)), cfg).orderBy("contig_id").collect())
    cut = B.fasta(*B.contig_chunks(table, size=size), cfg).orderBy("contig_id", "chunk").collect()
    assert "".join(r["value"] + "\n" for r in cut) == whole and len(cut) > 3


def test_large_bins_are_dealt_to_several_tasks(spark, monkeypatch):
    seqs = tiled(genome(random.Random(4), 400), 15, 30)
    table = U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=15)).cache()
    expected = sorted(tuple(r) for r in C.contigs(table).collect())
    nodes = C.oriented_nodes(table).withColumn("least", F.col("u")).withColumn("bin", F.lit(1))
    tasks = lambda block: C.dealt_by_bin(nodes, C.minimizer("u"), block).select(F.spark_partition_id()).distinct().count()
    with_conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        assert tasks(10_000) == 1 and tasks(50) > 5
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(C, "BLOCK", 50)
    assert sorted(tuple(r) for r in C.two_level(table, F.ascii("least"), 2).collect()) == expected

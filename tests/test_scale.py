"""Steps that must not grow faster than what they read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigua.config import Config
from contigua.functions import bloom, hashing, walks, windows
from contigua.operators import bidirected as B
from contigua.operators import contigs as C
from contigua.operators import growing, sketch, superkmers
from contigua.operators import kmers as K
from contigua.operators import ufx as U
from contigua.plans import queries
from contigua.operators.storage import written
from tests.test_engine import as_reads
from tests.test_packed import graphs, odd_reads


@pytest.mark.parametrize("k", [13, 31, 35])
def test_counts_are_combined_before_their_exchange(spark, k):
    cfg = Config(q_min=19, d_min=2, k=k)
    reads = odd_reads(spark)
    reads = reads.unionAll(reads).unionAll(reads.withColumn("seq", F.repeat(F.lit("A"), 700)).withColumn("qual", F.repeat(F.lit("h"), 700))).coalesce(1)
    expected = sorted(tuple(r) for r in K.extension_counts(K.canonicalised(K.good_quality(K.extract(reads, cfg), cfg)), cfg).collect())
    assert sorted(tuple(r) for r in superkmers.extension_counts(reads, cfg).collect()) == expected
    # a k-mer is exchanged once for each 255 times that a task has it
    assert superkmers.partial_counts(reads, cfg).count() <= len(expected) + 64 * 700 / 255


def test_reads_that_overlap_stay_together(spark):
    found = queries.reads(spark, "/root/testdata/sf0.01").select(F.input_file_name().alias("p"), "read_id")
    spans = found.groupBy("p").agg((F.max("read_id") - F.min("read_id") + 1 - F.count("*")).alias("gap"))
    assert spans.where("gap > 0").isEmpty()


def test_reads_in_parts():
    import pyarrow as pa

    texts = ["A" * n for n in (3, 0, 9, 1, 1, 30, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["read_id", "seq"])
    cut = [b.column(1).to_pylist() for b in windows.parts(batch, 10)]
    assert [x for c in cut for x in c] == texts and len(cut) > 2
    assert np.array_equal(windows.sums(np.full(600, 255, np.int64), np.array([0, 1])), [[255] + [0] * 7, [255 * 599] + [0] * 7])


@pytest.mark.parametrize("name, k, seqs", list(graphs()))
def test_words_make_the_pieces_of_strings(spark, monkeypatch, name, k, seqs):
    table = U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=k)).cache()
    for block in (1 << 18, 7):
        monkeypatch.setattr(C, "BLOCK", block)
        found = C.word_pieces(table, k).collect()
        # each oriented node is in one piece, and pieces come as pairs of strands
        kmers = sorted(r["seq"][i : i + k] for r in found for i in range(len(r["seq"]) - k + 1))
        assert kmers == sorted(r["u"] for r in C.oriented_nodes(table).collect())
        at = {r["id"]: r["seq"] for r in found}
        assert all(s == at[i ^ 1].translate(str.maketrans("ACGT", "TGCA"))[::-1] for i, s in at.items())


def test_large_bins_do_not_cut_neighbours_apart(spark, monkeypatch):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(400))] * 3
    table = U.ufx_table(as_reads(spark, seqs), Config(q_min=19, d_min=2, k=15)).cache()
    by_minimizer = C.word_pieces(table, 15).count()
    monkeypatch.setattr(C, "BLOCK", 100)
    assert C.word_pieces(table, 15, F.pmod(F.crc32("least"), F.lit(2))).count() < 2 * by_minimizer + 20


def test_buckets_follow_the_kmers(spark, monkeypatch):
    counts = spark.createDataFrame([(f"{i:04d}",) for i in range(100)], "kmer string")
    monkeypatch.setattr(growing, "BUCKET", 10)
    assert growing.buckets_for(counts, 8) == 10 and growing.buckets_for(counts.limit(3), 8) == 8


def test_streams_keep_no_state_of_kmers(spark, tmp_path):
    from contigua.operators.storage import new_folder
    from contigua.sources import fastq_stream
    from contigua.streaming.counts import count_available

    folder, state = tmp_path / "reads", new_folder(spark, "state")
    folder.mkdir()
    cfg = Config(q_min=19, d_min=2, k=5)
    for i, s in enumerate(("ACGTTGCATG", "GGATTACAGA")):
        (folder / f"{i}.fq").write_text(f"@r{i}\n{s}\n+\n{'h' * 10}\n")
        found = count_available(fastq_stream.stream_fastq(spark, str(folder)), str(new_folder(spark, "counts")), state, cfg, 4) if not i else found
    assert found.count() == superkmers.extension_counts(as_reads(spark, ["ACGTTGCATG"]), cfg).count()
    from pathlib import Path

    assert not Path(state.removeprefix("file://"), "state").exists()


@pytest.mark.parametrize("k", [9, 31, 40])
def test_runs_hold_each_occurrence_once(k):
    import pyarrow as pa

    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT" * 9 + "N") for _ in range(rng.randrange(150))) for _ in range(40)] + ["A" * 300]
    quals = ["".join(rng.choice("hB") for _ in s) for s in seqs]
    text = windows.Text.of(pa.array(seqs), pa.array(quals), windows.good_table("h"))
    _, n, _, begin, words, a, b = windows.runs(text, k, 7, 60)
    rows = lambda found: sorted(zip(*(x.tolist() for x in found if x is not None), strict=True))
    assert rows(windows.apart(n, begin[:-1], words, a, b, k)) == rows(windows.occurrences(text, k)) and n.max() <= 60


def test_steps_alone_are_exchanged(spark):
    nodes = spark.createDataFrame([("ACG", "T", "A"), ("CGA", "A", "G"), ("GAG", "T", "C")], "u string, l string, r string")
    for f, expected in ((C.edges, [("ACG", "CGA")]), (C.path_heads, [("ACG",), ("GAG",)]), (C.path_tails, [("CGA",), ("GAG",)])):
        found = f(nodes)
        assert sorted(tuple(r) for r in found.collect()) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Project [u#" not in plan and plan.count("AS step#") == 2


@pytest.mark.parametrize("grows", [False, True])
def test_filters_of_tables_have_parts_and_meet_each_kmer_once(spark, monkeypatch, grows):
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("ACGT") for _ in range(15)) for _ in range(3000)})
    word = lambda t: sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(t)))
    monkeypatch.setattr(bloom, "PART", 100)
    monkeypatch.setattr(bloom, "IN_MEMORY", 10)
    frame = lambda some: spark.createDataFrame([(word(t), t) for t in some], "kmer long, text string").repartition(3)
    added, asked = frame(texts[::2] + texts[:100:2]), frame(texts)
    if grows:
        words, filters = bloom.growing(added.select("kmer"), 150, k=15)
        found = bloom.held(asked, words, filters, 150, k=15)
        assert 3 < filters < 7 and words.select("part").distinct().count() == words.select("parts").first()[0] == 16
    else:
        found = bloom.answered(added.select("kmer"), asked, 1500, k=15)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2  # that of the frame and that by part
    maybe = {r["text"]: r["maybe"] for r in found.collect()}
    assert sorted(maybe) == texts and all(maybe[t] for t in texts[::2])
    assert sum(maybe[t] for t in texts[1::2]) < 40


def test_sets_of_reads_that_have_a_kmer(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "COMBINED", 50)
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTACGTN") for _ in range(n)) for n in (3, 4, 5, *[30] * 40)]
    expected: dict[str, int] = {}
    for i, s in enumerate(seqs):
        for at in range(len(s) - 3):
            if "N" not in (k := s[at : at + 4]):
                expected[k] = expected.get(k, 0) | 1 << i % 3
    frame = spark.createDataFrame([(i, s, "h" * len(s)) for i, s in enumerate(seqs)], "read_id long, seq string, qual string").repartition(3)
    found = superkmers.kmer_sets(frame, 4, F.col("read_id") % 3).collect()
    spelled = lambda w: "".join("ACGT"[w >> 2 * i & 3] for i in (3, 2, 1, 0))
    assert len(found) == len(expected) and {spelled(r["kmer"]): r["sets"] for r in found} == expected


@pytest.mark.parametrize("name, k, seqs", [g for g in graphs() if g[0] in ("branches", "circles and a line")])
def test_bidirected_pieces_are_walked_as_words(spark, monkeypatch, name, k, seqs):
    monkeypatch.setattr(C, "BLOCK", 5)
    cfg = Config(q_min=19, d_min=1, k=k)
    table = written(U.ufx_table(as_reads(spark, seqs), cfg), "ufx")
    found = B.joined_nodes(table, k)
    assert ("a" in found.columns) == (k % 2 == 1 and k <= 31)
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = found.collect()
    on = [min(x, rc(x)) for r in rows for x in (r["seq"][i : i + k] for i in range(len(r["seq"]) - k + 1))]
    assert sorted(on) == sorted(r["u"] for r in B.nodes(table).collect())
    for r in rows:
        nodes = [r["seq"][i : i + k] for i in range(len(r["seq"]) - k + 1)]
        least = min(min(x, rc(x)) for x in nodes)
        assert min(nodes[r["place"]], rc(nodes[r["place"]])) == least and (nodes[r["place"]] != least) == r["flip"]
    whole = lambda df: sorted(tuple(r) for r in df.collect())
    assert whole(B.whole(*B.contig_chunks(table, size=7))) == whole(C.contigs(table))


@pytest.mark.parametrize("k", [9, 35])
def test_first_occurrences_alone_are_exchanged(spark, monkeypatch, k):
    cfg = Config(q_min=19, d_min=2, k=k)
    reads = written(odd_reads(spark, k).withColumn("read_id", F.crc32(F.col("read_id").cast("string").cast("binary")) - 2000000000).repartition(3), "reads")
    expected = K.without_first(K.canonicalised(K.good_quality(K.extract(reads, cfg), cfg))).select("read_id", "pos", "kmer")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for combined in (1 << 22, 30):
        monkeypatch.setattr(superkmers, "COMBINED", combined)
        found = superkmers.without_first(reads, cfg)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
        assert found.schema == expected.schema or found.dtypes == expected.dtypes
        assert rows(found) == rows(expected)


@pytest.mark.parametrize("name, k, seqs", [g for g in graphs() if g[0] in ("branches", "circles and a line")])
def test_contigs_of_words_are_those_of_the_table(spark, monkeypatch, name, k, seqs):
    monkeypatch.setattr(C, "BLOCK", 30)
    cfg = Config(q_min=19, d_min=2, k=k)
    reads = as_reads(spark, seqs)
    words = superkmers.unique_words(reads, cfg)
    assert words.dtypes == [("word", "bigint"), ("l", "tinyint"), ("r", "tinyint")]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    expected = rows(C.contigs(written(U.ufx_table(reads, cfg), "ufx")))
    assert expected and rows(C.of_reads(reads, cfg)) == expected
    assert rows(B.whole(*B.contig_chunks(words, size=50, k=k))) == expected


@pytest.mark.parametrize("k", [9, 32, 35])
def test_distinct_kmers_are_exchanged_as_words(spark, monkeypatch, k):
    cfg = Config(q_min=19, d_min=2, k=k)
    reads = written(odd_reads(spark, k).repartition(3), "reads")
    expected = sorted(r["kmer"] for r in K.canonicalised(K.good_quality(K.extract(reads, cfg), cfg)).select("kmer").distinct().collect())
    number = lambda text: sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(text)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for combined in (1 << 22, 30):
        monkeypatch.setattr(superkmers, "COMBINED", combined)
        found = superkmers.distinct_kmers(reads, cfg)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan
        rows = found.collect()
        assert sorted(r["kmer"] for r in rows) == expected
        assert all(signed(number(r["kmer"][-32:])) == r["lo"] and (k <= 32 or number(r["kmer"][:-32]) == r["hi"]) for r in rows)
    # batches of a task cut runs of one k-mer
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(r["kmer"] for r in superkmers.distinct_kmers(reads, cfg).collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kmer_words_are_cut_as_words(spark):
    plan = queries.queries()["kmer_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "conv(" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("k", [13, 25, 35])
def test_sketches_of_words_drop_single_kmers_before_the_exchange(spark, monkeypatch, k):
    cfg = Config(q_min=19, d_min=2, k=k)
    # ids neither rise nor differ: reads that come in another order have the same first occurrence
    reads = written(odd_reads(spark, k).withColumn("read_id", F.crc32(F.substring("read_id", 2, 1).cast("binary")) - 2000000000).repartition(3), "reads")
    found = K.canonicalised(K.good_quality(K.extract(reads, cfg), cfg)).select("read_id", "pos", "kmer")
    rows = found.collect()
    times, places = {}, {}
    for r in rows:
        times[r["kmer"]] = times.get(r["kmer"], 0) + 1
        places.setdefault(r["kmer"], []).append((r["read_id"], r["pos"]))
    expected = sorted((*at, kmer) for kmer, some in places.items() for at in sorted(some)[1:])
    assert expected and sum(n == 1 for n in times.values()) > 5
    for slots, combined in ((64, 1 << 22), (1 << 10, 30), (1 << 20, 1 << 22)):
        monkeypatch.setattr(superkmers, "COMBINED", combined)
        out = sketch.repeated_of_reads(reads, cfg, slots)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
        assert sorted(tuple(r) for r in out.collect()) == expected
    # a slot a k-mer, nearly: the slots taken twice are those of k-mers that repeat
    words = sketch.repeated_words(reads, cfg, 1 << 20).collect()
    assert sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in words) <= sum(n > 1 for n in times.values()) + 2
    assert sketch.repeated_of_reads(reads.limit(0), cfg, 64).count() == 0
    with pytest.raises(ValueError, match="64"):
        sketch.repeated_words(reads, cfg, 100)


@pytest.mark.parametrize("bits", [10, 40, 50, 64])
def test_order_of_words(bits):
    rng = np.random.default_rng(bits)
    some = rng.integers(0, 1 << bits, 5000, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 64, 5000, np.uint64)
    # words that only their last bits tell apart, and equal ones
    close = (some[:50, None] & np.uint64((1 << bits) - 1024 if bits > 10 else 0) | np.arange(64, dtype=np.uint64)[::-1]).ravel()
    for x in (np.r_[some, close, some[:99]], some[:1], some[:0]):
        assert np.array_equal(windows.order(x, bits), np.argsort(x, kind="stable"))


@pytest.mark.parametrize("k", [16, 23, 31, 32])
def test_minimum_hashes_of_words_are_those_of_strings(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(40)] + ["T" * k, "A" * k]
    word = np.array([sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(t))) for t in texts], np.uint64)
    found = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", hashing.min_hash("s", k).alias("h")).collect()
    assert hashing.min_hash_words(word, k).tolist() == [h for _, h in sorted(tuple(r) for r in found)]
    with pytest.raises(ValueError, match="16"):
        hashing.min_hash_words(word, 15)


@pytest.mark.parametrize("name, k, seqs", [g for g in graphs() if g[0] in ("branches", "circles and a line")])
def test_two_levels_of_words_are_contigs(spark, monkeypatch, name, k, seqs):
    cfg = Config(q_min=19, d_min=2, k=k)
    reads = as_reads(spark, seqs)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    expected = rows(C.contigs(written(U.ufx_table(reads, cfg), "ufx")))
    words = superkmers.unique_words(reads, cfg)
    bin_of = lambda word: (word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % 3
    sizes = sorted(np.bincount(bin_of(np.array([r["word"] for r in words.select("word").collect()], np.int64).view(np.uint64))).tolist())
    # all bins are small, or some are
    for block in (1 << 18, sizes[0]):
        monkeypatch.setattr(C, "BLOCK", block)
        assert rows(C.two_level_of_words(words, bin_of, k)) == expected


def test_bins_of_minimum_hashes_need_no_strings(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("a table of strings, or pointers that are doubled")

    for at, name in ((U, "ufx_table"), (C, "_doubled"), (hashing, "min_hash")):
        monkeypatch.setattr(at, name, never)
    assert queries.queries()["contig_join_minhash"](spark, "/root/testdata/sf0.001").count() > 0

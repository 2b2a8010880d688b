"""Golden cases, known answers, edge cases and properties of the sequence engine."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from contigua.config import Config, load_config, parse_config
from contigua.functions import bloom, dna, hashing
from contigua.operators import contigs as C
from contigua.operators import kmers as K
from contigua.operators import ufx as U
from contigua.sources import fastq, tables
from contigua.streaming.counts import stream_extension_counts

GOLDEN = [
    ("r1", "ACGTTGCATG", "hhhhhhhhhh"),
    ("r2", "GTCCATGCAA", "hhhhhhhhhh"),
    ("r3", "TTGCATGGAC", "hhhhhhhhhh"),
    ("r4", "ACGTTNCATG", "hhhhhBhhhh"),
    ("r5", "CGTTGCATGG", "hhhShTBhhh"),
]
CFG = Config(q_min=19, d_min=2, k=5)
COLUMNS = "read_id string, seq string, qual string"


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def as_reads(spark, seqs, qual="h"):
    return spark.createDataFrame([(f"r{i}", s, qual * len(s)) for i, s in enumerate(seqs)], COLUMNS)


def sequences(df):
    return sorted(r["seq"] for r in df.collect())


def tiled(genome, k, n, circular=False):
    """Each window of n bases, twice; d_min 2 keeps all k-mers of the middle."""
    long = genome + genome[: n - 1] if circular else genome
    return [long[i : i + n] for i in range(len(long) - n + 1) for _ in range(2)]


def model(seqs, k, d_min):
    """Contigs by a plain dictionary walk, without cycles."""
    counts = {}
    for s in seqs:
        for o in (s, revcomp(s)):
            for i in range(len(o) - k + 1):
                c = counts.setdefault(o[i : i + k], ({}, {}))
                for side, j in ((0, i - 1), (1, i + k)):
                    if 0 <= j < len(o):
                        c[side][o[j]] = c[side].get(o[j], 0) + 1
    nodes = {}
    for u, (left, right) in counts.items():
        if u == revcomp(u):
            continue
        valid = [[b for b, n in side.items() if n >= d_min] for side in (left, right)]
        if all(len(v) == 1 for v in valid):
            nodes[u] = (valid[0][0], valid[1][0])
    step = lambda u: v if (v := u[1:] + nodes[u][1]) in nodes and nodes[v][0] == u[0] else None
    led_to = {step(u) for u in nodes}
    out = set()
    for u in nodes:
        if u not in led_to:
            s, v = u, u
            while (v := step(v)) is not None:
                s += v[-1]
            out.add(min(s, revcomp(s)))
    return sorted(out)


def test_golden_occurrences(spark):
    reads = spark.createDataFrame([GOLDEN[3], GOLDEN[4]], COLUMNS)
    rows = {(r.read_id, r.kmer): (r.l, r.lq, r.r, r.rq) for r in K.extract(reads, CFG).collect()}
    assert rows == {
        ("r4", "ACGTT"): (None, 0, "A", 2),
        ("r5", "CGTTG"): (None, 0, "C", 20),
        ("r5", "GTTGC"): ("C", 40, "A", 2),
        ("r5", "TTGCA"): ("G", 40, "T", 40),
        ("r5", "TGCAT"): ("T", 40, "G", 40),
        ("r5", "GCATG"): ("T", 19, "G", 40),
        ("r5", "CATGG"): ("G", 40, None, 0),
    }
    assert K.good_quality(K.extract(reads, CFG), CFG).where("read_id = 'r4'").isEmpty()


def test_golden_table_and_contig(spark):
    table = U.ufx_table(spark.createDataFrame(GOLDEN, COLUMNS), CFG)
    rows = {r.kmer: r.lext + r.rext for r in U.both_strands(U.with_letters(table)).collect()}
    assert rows == {
        "ATGCA": "CA", "TGCAT": "TG", "CAACG": "GX", "CGTTG": "XC", "CATGG": "GA", "CCATG": "TC", "GTCCA": "XT", "TGGAC": "AX",
        "ATGGA": "CC", "TCCAT": "GG", "CATGC": "CA", "GCATG": "TG", "GCAAC": "XG", "GTTGC": "CX", "TGCAA": "AC", "TTGCA": "GT",
    }
    assert sorted(r.kmer for r in U.unique_both(table).collect()) == ["ATGCA", "ATGGA", "CATGC", "CATGG", "TGCAA"]
    assert [tuple(r) for r in C.contigs(table).collect()] == [("TCCATGCAA", "G", "C", 9)]
    reads = spark.createDataFrame(GOLDEN, COLUMNS)
    assert C.assemble(reads, CFG).count() == 0
    assert C.assemble(reads, Config(q_min=19, d_min=2, k=5, min_contig_len=9)).count() == 1


def test_random_graphs_match_the_model(spark):
    rng = random.Random(7)
    for trial in range(3):
        parts = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(4)]
        genome = parts[0] + parts[1] + parts[2] + parts[1] + parts[3]
        seqs = [genome[i : i + 40] for i in range(0, len(genome) - 40, 3)]
        seqs = [revcomp(s) if rng.random() < 0.5 else s for s in seqs]
        cfg = Config(d_min=2, k=11)
        expected = model(seqs, 11, 2)
        table = U.ufx_table(as_reads(spark, seqs), cfg)
        assert sequences(C.contigs(table)) == expected
        if trial == 0:
            rng.shuffle(seqs)
            other = U.ufx_table(as_reads(spark, [revcomp(s) for s in seqs]).repartition(7), cfg)
            assert sequences(C.contigs(other)) == expected
            assert sequences(C.two_level(table, F.crc32("least"), 3)) == expected
            assert all(set(s) <= set("ACGT") for s in expected)


def test_repeat_free_genome_gives_one_contig_of_it(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    found = sequences(C.contigs(U.ufx_table(as_reads(spark, tiled(genome, 21, 50)), Config(d_min=2, k=21))))
    assert len(found) == 1
    assert found[0] in genome or revcomp(found[0]) in genome


def test_circle_hairpin_and_homopolymer(spark):
    rng = random.Random(11)
    circle = "".join(rng.choice("ACGT") for _ in range(200))
    cfg = Config(d_min=2, k=21)
    table = U.ufx_table(as_reads(spark, tiled(circle, 21, 40, circular=True)), cfg)
    found = C.contigs(table).collect()
    assert [r.len for r in found] == [221]
    assert sequences(C.two_level(table, F.crc32("least"), 3)) == [found[0].seq]
    x = "".join(rng.choice("ACGT") for _ in range(50))
    hairpin = C.contigs(U.ufx_table(as_reads(spark, tiled(x + revcomp(x), 21, 40)), cfg)).collect()
    assert [r.len for r in hairpin] == [98]
    poly = C.contigs(U.ufx_table(as_reads(spark, ["A" * 40] * 3), cfg)).collect()
    assert [r.len for r in poly] == [22]


def test_two_circles_and_a_line(spark):
    rng = random.Random(5)
    a, b, line = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (150, 90, 313))
    seqs = tiled(a, 21, 40, True) + tiled(b, 21, 40, True) + tiled(line, 21, 40)
    found = C.contigs(U.ufx_table(as_reads(spark, seqs), Config(d_min=2, k=21))).collect()
    assert sorted(r.len for r in found)[:2] == [111, 171]


def test_short_bad_and_odd_reads(spark):
    cfg = Config(k=5, d_min=1)
    assert K.extract(as_reads(spark, ["ACG", ""]), cfg).count() == 0
    with pytest.raises(PySparkException):
        K.extract(as_reads(spark, ["acgtacgt"]), cfg).collect()
    drop = Config(k=5, d_min=1, mode="DROP")
    assert K.extract(as_reads(spark, ["acgtacgt", "ACGTAC"]), drop).count() == 2
    low = as_reads(spark, ["ACGTACG"], qual="#")
    assert K.extract(low, cfg).agg(F.max("lq")).first()[0] == 227
    with pytest.raises(PySparkException):
        K.extract(low, Config(k=5, d_min=1, wrap_quality=False)).collect()
    empty = U.ufx_table(as_reads(spark, ["ACG"]), cfg)
    assert C.contigs(empty).count() == 0


def test_counts_do_not_wrap(spark):
    reads = spark.range(70_000).select(F.lit("r").alias("read_id"), F.lit("AACCGGT").alias("seq"), F.lit("hhhhhhh").alias("qual"))
    rows = K.extension_counts(K.canonicalised(K.extract(reads, Config(k=5, d_min=1))), Config(k=5, d_min=1)).collect()
    assert max(r["lA"] for r in rows) == 70_000


def test_config():
    found = parse_config('; c\ndefaults\n{\n K "31" ; note\n D_MIN "3"\n OTHER "x"\n}\n')
    assert (found.k, found.d_min, found.q_min, found.least_length, found.fasta_textwidth) == (31, 3, 19, 62, 50)
    with pytest.raises(ValueError):
        Config(d_min=0)


def test_load_config(spark, tmp_path):
    assert load_config(spark, f"{tmp_path}/none") == Config()
    (tmp_path / "c.conf").write_text('defaults { FASTA_TEXTWIDTH "70" }')
    assert load_config(spark, f"{tmp_path}/c.conf").fasta_textwidth == 70


def test_fastq_ranges_own_each_record_once(spark, tmp_path):
    reads = [(f"r{i} x", "ACGTN"[i % 5] * (1 + i % 60), "@+Bh"[i % 4] * (1 + i % 60)) for i in range(300)]
    text = "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in reads)
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq").write_text(text.replace("\n", "\r\n") + "\r\n")
    (tmp_path / "c.fastq").write_text("")
    (tmp_path / "d.fastq").write_text("@long\n" + "A" * 2000 + "\n+\n" + "h" * 2000)
    for split in (50, 97, 1 << 20):
        found = sorted(tuple(r) for r in fastq.read_fastq(spark, str(tmp_path), split).collect())
        assert found == sorted(reads + reads + [("long", "A" * 2000, "h" * 2000)])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "e.fastq").write_text("@a\nACGT\n+\nhh\n")
    with pytest.raises(PySparkException):
        fastq.read_fastq(spark, str(tmp_path / "bad")).collect()


def test_files_round_trip(spark, tmp_path):
    table = U.ufx_table(spark.createDataFrame(GOLDEN, COLUMNS), CFG)
    tables.write_ufx(table, f"{tmp_path}/ufx")
    again = tables.read_ufx(spark, f"{tmp_path}/ufx")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    assert sequences(C.contigs(again)) == ["TCCATGCAA"]
    found = spark.createDataFrame([("ACGTACGTAC", "A", "C", 10), ("GGGGG", "T", "T", 5)], "seq string, left_ext string, right_ext string, len long")
    tables.write_fasta(C.with_ids(found), f"{tmp_path}/fa", Config(k=5, fasta_textwidth=5), one_file=True)
    lines = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/fa", wholetext=True).collect())
    assert lines == ">contig 1 len 10 left_ext A right_ext C\nACGTA\nCGTAC\n>contig 2 len 5 left_ext T right_ext T\nGGGGG\n"


def test_hashes():
    h = lambda t, c, b: tuple(f"{int(x[0]):08x}" for x in hashing.hashlittle2(np.frombuffer(t, np.uint8).reshape(1, -1), c, b))
    text = b"Four score and seven years ago"
    assert h(b"", 0, 0) == ("deadbeef", "deadbeef")
    assert h(b"", 0, 0xDEADBEEF) == ("bd5b7dde", "deadbeef")
    assert h(b"", 0xDEADBEEF, 0xDEADBEEF) == ("9c093ccd", "bd5b7dde")
    assert h(text, 0, 0) == ("17770551", "ce7226e6")
    assert h(text, 0, 1) == ("e3607cae", "bd371de4")
    assert h(text, 1, 0) == ("cd628161", "6cbea4b3")
    assert hashing.unpacked(hashing.packed(["ACGTT", "GGGCA"]), 5) == ["ACGTT", "GGGCA"]


def test_min_hash_and_columns(spark):
    df = spark.createDataFrame([("ACGT" * 10 + "G",)], "kmer string")
    assert df.select(hashing.min_hash("kmer", 41)).first()[0] == 173703339
    row = spark.createDataFrame([("ACGTT", "N")], "s string, c string").select(dna.revcomp("s"), dna.canonical("s"), dna.base_code("c"), dna.compare("s", "s", 3, 0, 1)).first()
    assert tuple(row) == ("AACGT", "AACGT", 0, -1)
    assert (dna.packed_size(41), dna.occurrence_size(41)) == (11, 14)


def test_bloom_filters(spark):
    rng = random.Random(1)
    kmers = list({"".join(rng.choice("ACGT") for _ in range(21)) for _ in range(3000)})
    f = bloom.ScalableBloomFilter(100)
    f.add(kmers[:2000])
    assert len(f.filters) > 3 and f.check(kmers[:2000]).all()
    assert f.check(kmers[2000:]).mean() < 0.02
    df = spark.createDataFrame([(k,) for k in kmers[:500]], "kmer string")
    built = bloom.build(df, 500)
    assert df.where(~bloom.contains(built, "kmer")).isEmpty()
    assert built.check(kmers[2000:]).mean() < 0.02


def test_bloom_membership_fits_its_kmers(spark, monkeypatch):
    from contigua.plans import queries

    asked, build = [], bloom.build
    monkeypatch.setattr(bloom, "build", lambda df, capacity: asked.append((df.count(), capacity)) or build(df, capacity))
    (row,) = queries.queries()["bloom_membership"](spark, "/root/testdata/sf0.001").collect()
    assert asked and all(n == capacity for n, capacity in asked)
    assert row["missed"] == 0 and row["within"] and 0 < row["members"] < row["asked"]


def test_large_filters_stay_tables_with_the_same_answers(spark, monkeypatch):
    rng = random.Random(4)
    kmers = sorted({"".join(rng.choice("ACGT") for _ in range(21)) for _ in range(4000)})
    frame = lambda some: spark.createDataFrame([(k,) for k in some], "kmer string").repartition(3)
    answers = lambda: {r["kmer"]: r["maybe"] for r in bloom.answered(frame(kmers[::2]), frame(kmers), len(kmers) // 2).collect()}
    small = answers()
    monkeypatch.setattr(bloom, "IN_MEMORY", 10)
    monkeypatch.setattr(bloom, "build", None)
    assert answers() == small and len(small) == len(kmers) and all(small[k] for k in kmers[::2])


def test_growing_filter_equals_the_one_in_memory(spark):
    rng = random.Random(2)
    kmers = sorted({"".join(rng.choice("ACGT") for _ in range(21)) for _ in range(900)})
    added, other = sorted(kmers[::2]), kmers[1::2]
    model = bloom.ScalableBloomFilter(40)
    model.add(added)
    words, filters = bloom.growing(spark.createDataFrame([(k,) for k in added], "kmer string").repartition(5), 40)
    assert filters == len(model.filters) > 3
    found = {r["kmer"]: r["maybe"] for r in bloom.held(spark.createDataFrame([(k,) for k in kmers], "kmer string"), words, filters, 40).collect()}
    assert found == dict(zip(kmers, model.check(kmers).tolist(), strict=True))
    assert all(found[k] for k in added) and sum(found[k] for k in other) < len(other) / 20


def test_long_paths_are_joined_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BITS", 3)
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(700))
    reads = [genome[i : i + 60] for i in range(0, 641, 4)] * 3
    found = C.assemble(as_reads(spark, reads), Config(k=21, d_min=2, min_contig_len=1)).collect()
    longest = max(found, key=lambda r: r["len"])["seq"]
    assert longest in genome or longest in genome.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert len(longest) > 600


def test_walked_pieces():
    # TACG -> ACGT -> CGTT by steps of five bases, and a circle of two
    rows = [("ACGT", "T", "T"), ("TACG", "G", "T"), ("CGTT", "A", "X"), ("ATAT", "T", "A"), ("TATA", "A", "T")]
    found = sorted(C.walked(*(list(c) for c in zip(*rows, strict=True))))
    assert found[1:] == [("TACGTT", "G", "X")]
    assert found[0][0] in ("ATATA", "TATAT")


def test_lines_are_cut_at_any_block(monkeypatch):
    import io

    from contigua.sources import fastq

    text = b"@a\r\nACGT\n+\nhhhh\n\n@long\n" + b"ACGT" * 50 + b"\n+\n" + b"h" * 200
    whole, at = [], 0
    for line in text.split(b"\n"):
        whole.append((at, line.rstrip(b"\r")))
        at += len(line) + 1
    for block in (1, 2, 7, 64, 1 << 18):
        monkeypatch.setattr(fastq, "BLOCK", block)
        lines = fastq.Lines(io.BytesIO(text), 0)
        assert list(iter(lines.next, None)) == whole


def test_without_first_and_spectrum(spark):
    rows = K.extract(as_reads(spark, ["ACGTACGTA", "ACGTAC"]), Config(k=5, d_min=1))
    n = rows.count()
    assert K.without_first(rows).count() == n - rows.select("kmer").distinct().count()
    assert K.spectrum(rows).agg(F.sum(F.col("n") * F.col("kmers"))).first()[0] == n


def test_streamed_counts(spark, tmp_path):
    reads = spark.createDataFrame(GOLDEN, COLUMNS)
    reads.write.parquet(f"{tmp_path}/in")
    stream = stream_extension_counts(spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/in"), CFG)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    expected = K.extension_counts(K.canonicalised(K.good_quality(K.extract(reads, CFG), CFG)), CFG)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, expected.collect()))

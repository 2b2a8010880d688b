"""Registered queries of the sequence engine and their SQL counterparts.

No test table holds DNA, so reads are derived from orders by expressions that Spark and DuckDB share: eight overlapping reads of 64
bases from each stretch of 128, every third one from the other strand, every eleventh with an N.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.config import Config, load_config
from contigua.functions import bloom, dna, hashing, packed
from contigua.operators import bidirected as B
from contigua.operators import contigs as C
from contigua.operators import growing, sketch, superkmers
from contigua.operators import kmers as K
from contigua.operators import ufx as U
from contigua.operators.storage import new_folder, written
from contigua.sources import bam, committed, fastq, fastq_stream, tables
from contigua.streaming.counts import count_available

CFG = Config(q_min=19, d_min=2, k=15, min_contig_len=40)
#: k of the queries on minimum hashes, which need 16 bases at least.
LONG_K = 31
BINS = 16
LONG = Config(q_min=19, d_min=2, k=LONG_K, min_contig_len=40)
#: k of the queries on k-mers of two words.
LONG_TWO = Config(q_min=19, d_min=2, k=41, min_contig_len=40)
#: Bins of k-mers by two letters.
LETTER_BINS = 5

READS_SQL = """
  SELECT read_id,
    CASE WHEN read_id % 11 = 0 THEN concat(substring(s1, 1, 20), 'N', substring(s1, 22)) ELSE s1 END AS seq,
    CASE WHEN read_id % 3 = 1 THEN reverse(q0) ELSE q0 END AS qual
  FROM (
    SELECT read_id, q0, CASE WHEN read_id % 3 = 1 THEN reverse(translate(s0, 'ACGT', 'TGCA')) ELSE s0 END AS s1
    FROM (
      SELECT o_orderkey AS read_id,
        substring(translate(concat(
          md5(concat('a', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) AS STRING))), md5(concat('b', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) AS STRING))),
          md5(concat('c', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) AS STRING))), md5(concat('d', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) AS STRING)))),
          '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(1 + (o_orderkey % 8) * 8 AS INT), 64) AS s0,
        repeat(translate(md5(concat('q', CAST(o_orderkey AS STRING))), '0123456789abcdef', 'BhhhhhhhhhhhhhhT'), 2) AS q0
      FROM orders
    ) AS base
  ) AS strand
"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a read becomes some fifty k-mers: few small files would leave most cores idle. Keys are dealt, as they are shorter than reads, and by range, as reads that overlap
    # are then counted together; nothing depends on it
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartitionByRange(4 * spark.sparkContext.defaultParallelism, "o_orderkey").sortWithinPartitions("o_orderkey")
    # written first, as a table of reads is what engines start from; else its expressions are repeated wherever a filter is pushed down
    found = spark.sql(READS_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
    return written(found, "reads")


Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cfg: Config = CFG) -> Callable[[Query], Query]:
    """Registers a query under its name, with the last SELECT of its SQL over the common tables below."""

    def put(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_common(sql, cfg)
        return f

    return put


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_rotated = lambda x, n: f"(((({x}) << {n}) & 4294967295) | (({x}) >> {32 - n}))"


def quality_sql(at: str) -> str:
    return f"CAST((ascii(substring(qual, {at}, 1)) - 64) & 255 AS SMALLINT)"


def bin_sql(u: str) -> str:
    """The bin of a k-mer's canonical form by two of its letters."""
    least = f"least({u}, {rc(u)})"
    return f"(ascii(substring({least}, 3, 1)) + ascii(substring({least}, 8, 1))) % {LETTER_BINS}"


def common(cfg: Config) -> dict[str, tuple[tuple[str, ...], str]]:
    """Tables that the SQL of queries may name, each with those that it needs; MATERIALIZED where several read it."""
    k, q, d = cfg.k, cfg.q_min, cfg.d_min
    counts = ", ".join(f"count(*) FILTER (WHERE {s} = '{b}' AND {s}q > {q}) AS {s}{b}" for s in "lr" for b in "ACGT")
    mask = {s: " + ".join(f"CASE WHEN {s}{b} >= {d} THEN {1 << i} ELSE 0 END" for i, b in enumerate("ACGT")) for s in "lr"}
    letter = lambda m: f"CASE {m} WHEN 0 THEN 'X' WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' WHEN 8 THEN 'T' ELSE 'F' END"
    flip = f"{rc('kmer')} < kmer"
    walk = lambda links: f"""SELECT u AS head, u, u AS seq, l AS left_ext, r AS right_ext FROM nodes WHERE u NOT IN (SELECT v FROM {links})
        UNION ALL SELECT w.head, e.v, concat(w.seq, right(e.v, 1)), w.left_ext, n.r FROM {links}_walk w JOIN {links} e ON e.u = w.u JOIN nodes n ON n.u = e.v"""  # noqa: E731
    one_strand = lambda walked: f"""SELECT seq, min(left_ext) AS left_ext, min(right_ext) AS right_ext, CAST(length(seq) AS BIGINT) AS len FROM (
        SELECT least(seq, {rc("seq")}) AS seq, CASE WHEN {rc("seq")} < seq THEN translate(right_ext, 'ACGT', 'TGCA') ELSE left_ext END AS left_ext,
        CASE WHEN {rc("seq")} < seq THEN translate(left_ext, 'ACGT', 'TGCA') ELSE right_ext END AS right_ext FROM {walked}) AS one GROUP BY seq"""  # noqa: E731
    return {
        "reads": ((), READS_SQL),
        "windows": (("reads",), f"SELECT read_id, seq, qual, CAST(p AS INT) AS pos, substring(seq, CAST(p AS INT) + 1, {k}) AS kmer FROM reads, unnest(range(0, length(seq) - {k} + 1)) AS t(p)"),
        "occurrences": (
            ("windows",),
            f"""SELECT read_id, pos, kmer, CASE WHEN pos > 0 THEN translate(substring(seq, pos, 1), 'N', 'A') END AS l, CASE WHEN pos > 0 THEN {quality_sql("pos")} ELSE CAST(0 AS SMALLINT) END AS lq,
            CASE WHEN pos + {k} < length(seq) THEN translate(substring(seq, pos + {k} + 1, 1), 'N', 'A') END AS r,
            CASE WHEN pos + {k} < length(seq) THEN {quality_sql(f"pos + {k} + 1")} ELSE CAST(0 AS SMALLINT) END AS rq FROM windows WHERE instr(kmer, 'N') = 0""",
        ),
        "good": (("occurrences",), f"SELECT * FROM occurrences WHERE lq > {q} OR rq > {q}"),
        "canon": (
            ("good",),
            f"""SELECT read_id, pos, least(kmer, {rc("kmer")}) AS kmer, CASE WHEN {flip} THEN translate(r, 'ACGT', 'TGCA') ELSE l END AS l, CASE WHEN {flip} THEN rq ELSE lq END AS lq,
            CASE WHEN {flip} THEN translate(l, 'ACGT', 'TGCA') ELSE r END AS r, CASE WHEN {flip} THEN lq ELSE rq END AS rq FROM good""",
        ),
        "counts": (("canon",), f"SELECT kmer, {counts} FROM canon GROUP BY kmer"),
        "masks": (("counts",), f"SELECT kmer, CAST({mask['l']} AS TINYINT) AS lmask, CAST({mask['r']} AS TINYINT) AS rmask FROM counts"),
        "ufx": (("masks",), "SELECT * FROM masks WHERE lmask > 0 OR rmask > 0"),
        "lettered": (("ufx",), f"SELECT kmer, {letter('lmask')} AS lext, {letter('rmask')} AS rext FROM ufx"),
        "strands": (("lettered",), f"SELECT kmer, lext, rext FROM lettered UNION ALL SELECT {rc('kmer')}, translate(rext, 'ACGT', 'TGCA'), translate(lext, 'ACGT', 'TGCA') FROM lettered"),
        "nodes": (("strands",), "SELECT kmer AS u, lext AS l, rext AS r FROM strands WHERE lext IN ('A', 'C', 'G', 'T') AND rext IN ('A', 'C', 'G', 'T')"),
        # one key, the k + 1 bases of a step, so that there is one way to join
        "ahead": (("nodes",), "SELECT u, concat(u, r) AS step FROM nodes"),
        "back": (("nodes",), "SELECT u AS v, concat(l, u) AS step FROM nodes"),
        "links": (("ahead", "back"), "SELECT u, v FROM ahead JOIN back USING (step)"),
        "links_walk": (("nodes", "links"), walk("links")),
        "walked": (("links_walk", "links"), "SELECT seq, left_ext, right_ext FROM links_walk WHERE u NOT IN (SELECT u FROM links)"),
        "contigs": (("walked",), one_strand("walked")),
        "inside": (("links",), f"SELECT u, v FROM links WHERE {bin_sql('u')} = {bin_sql('v')}"),
        "inside_walk": (("nodes", "inside"), walk("inside")),
        "inside_walked": (("inside_walk", "inside"), "SELECT seq, left_ext, right_ext FROM inside_walk WHERE u NOT IN (SELECT u FROM inside)"),
        "pieces": (("inside_walked",), one_strand("inside_walked")),
        "numbered": (("contigs",), "SELECT row_number() OVER (ORDER BY len DESC, seq) AS contig_id, * FROM contigs"),
    }


SHARED = frozenset({"nodes", "links", "inside", "ahead", "back"})


def with_common(sql: str, cfg: Config) -> str:
    """A statement after the common tables that it names, in order."""
    tables, need = common(cfg), set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            for n in tables[name][0]:
                add(n)

    for name in tables:
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", sql):
            add(name)
    if not need:
        return sql
    recursive = "RECURSIVE " if any(n.endswith("_walk") for n in need) else ""
    return f"WITH {recursive}{', '.join(f'{n} AS {"MATERIALIZED " if n in SHARED else ""}({body})' for n, (_, body) in tables.items() if n in need)} {sql}"


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    return K.extract(reads(spark, d), CFG)


def canon(spark: SparkSession, d: str) -> DataFrame:
    return K.canonicalised(K.good_quality(K.extract(reads(spark, d), CFG, strands=True), CFG))


def table(spark: SparkSession, d: str) -> DataFrame:
    return U.ufx_table(reads(spark, d), CFG)


def long_kmers(spark: SparkSession, d: str) -> DataFrame:
    return K.without_n(K.windows(reads(spark, d), LONG_K)).select("kmer").distinct()


# reads and their k-mers


@query("SELECT read_id, pos, kmer FROM windows")
def kmer_extract(spark, d):
    return K.windows(reads(spark, d), CFG.k).select("read_id", "pos", "kmer")


@query("SELECT read_id, pos, kmer FROM windows WHERE instr(kmer, 'N') = 0")
def kmer_nskip(spark, d):
    return K.without_n(K.windows(reads(spark, d), CFG.k)).select("read_id", "pos", "kmer")


@query("SELECT * FROM occurrences")
def kmer_extensions(spark, d):
    return occurrences(spark, d)


@query(f"SELECT read_id, CAST(p AS INT) AS pos, {quality_sql('CAST(p AS INT)')} AS quality FROM reads, unnest(range(1, length(qual) + 1)) AS t(p)")
def quality_decode(spark, d):
    return K.decoded_qualities(reads(spark, d), CFG).select("read_id", F.posexplode("quals").alias("pos", "quality")).withColumn("pos", F.col("pos") + 1)


@query("SELECT read_id, seq, qual FROM reads")
def fastq_scan(spark, d):
    """Writes the reads as FASTQ files and reads them by small byte ranges."""
    path = new_folder(spark, "fastq")
    fastq.write_fastq(reads(spark, d), path)
    return fastq.read_fastq(spark, path, split=1 << 20).withColumn("read_id", F.col("read_id").cast("long"))


@query("SELECT read_id, seq, qual FROM reads")
def bam_scan(spark, d):
    """Writes the reads as BAM files and reads them by small byte ranges."""
    path = new_folder(spark, "bam")
    bam.write_bam(reads(spark, d), path)
    return bam.read_bam(spark, path, split=1 << 16).withColumn("read_id", F.col("read_id").cast("long"))


@query("SELECT CAST(sum(length(CAST(read_id AS STRING)) + length(seq) + length(qual) + 6) AS BIGINT) AS bytes FROM reads")
def fastq_bytes(spark, d):
    """The size of the reads as files: at, plus and four line ends beside what a read holds."""
    path = new_folder(spark, "fastq")
    fastq.write_fastq(reads(spark, d), path)
    return fastq.total_bytes(spark, path).select(F.col("bytes").cast("long").alias("bytes"))


CONFIG_FILE = """; a comment
defaults {
  Q_MIN "21"   ; another
  K "33"
  FASTA_TEXTWIDTH 60
  UNKNOWN "1"
}
"""


def _config_row(source: str, c: Config) -> str:
    kmers = f"CAST(({with_common('SELECT count(*) FROM good', c)}) AS BIGINT)"
    return f"""SELECT '{source}' AS source, {c.q_min} AS q_min, {c.d_min} AS d_min, {c.k} AS k, {c.least_length} AS min_contig_len, {c.fasta_textwidth} AS fasta_textwidth,
        {-(-c.k // 4)} AS packed, {3 + -(-c.k // 4)} AS occurrence, {kmers} AS kmers, {kmers} * {3 + -(-c.k // 4)} AS bytes"""


@query(f"{_config_row('file', Config(q_min=21, k=33, fasta_textwidth=60))} UNION ALL {_config_row('none', Config())}")
def config_file(spark, d):
    """A configuration file that sets some keys, and none at all: parameters, bytes of a packed k-mer and of an occurrence, and the good k-mers of the reads by these, with all their bytes."""
    path = new_folder(spark, "config")
    spark.createDataFrame([(CONFIG_FILE,)], "value string").coalesce(1).write.text(path)
    found = (("file", load_config(spark, path)), ("none", load_config(spark, f"{path}/none")))
    text, out = reads(spark, d), None
    for name, c in found:
        fixed = {"source": name, "q_min": c.q_min, "d_min": c.d_min, "k": c.k, "min_contig_len": c.least_length, "fasta_textwidth": c.fasta_textwidth, "packed": dna.packed_size(c.k), "occurrence": dna.occurrence_size(c.k)}
        n = K.good_quality(K.extract(text, c), c).agg(F.count("*").alias("kmers"))
        row = n.select(*(F.lit(v).alias(k) for k, v in fixed.items()), "kmers", (F.col("kmers") * fixed["occurrence"]).alias("bytes"))
        out = row if out is None else out.unionAll(row)
    return out


# bases and strands


@query(f"SELECT read_id, {rc('seq')} AS rc FROM reads")
def revcomp(spark, d):
    return reads(spark, d).select("read_id", dna.revcomp("seq").alias("rc"))


@query("SELECT * FROM canon")
def canonical_kmers(spark, d):
    return canon(spark, d)


@query(f"SELECT kmer <= {rc('kmer')} AS canonical, count(*) AS n FROM occurrences GROUP BY 1")
def is_canonical(spark, d):
    return occurrences(spark, d).groupBy(dna.is_canonical("kmer").alias("canonical")).agg(F.count("*").alias("n"))


@query(
    """SELECT code, 3 - code AS paired, substring('ACGT', code + 1, 1) AS base, count(*) AS n
    FROM (SELECT CAST(instr('ACGT', translate(substring(seq, CAST(p AS INT), 1), 'N', 'A')) - 1 AS INT) AS code FROM reads, unnest(range(1, length(seq) + 1)) AS t(p)) AS c GROUP BY 1, 2, 3"""
)
def base_codes(spark, d):
    letters = reads(spark, d).select(F.explode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("c"))
    codes = letters.select(dna.base_code("c").cast("int").alias("code"))
    return codes.groupBy("code", dna.inverse_code("code").cast("int").alias("paired"), dna.code_base("code").alias("base")).agg(F.count("*").alias("n"))


@query("SELECT read_id, regexp_full_match(seq, '[ACGT]*') AS dna, regexp_full_match(seq, '[ACGTN]*') AS dna_or_n FROM reads")
def alphabet_check(spark, d):
    return reads(spark, d).select("read_id", dna.is_dna("seq").alias("dna"), dna.is_dna("seq", with_n=True).alias("dna_or_n"))


@query(
    """SELECT read_id, CASE WHEN substring(seq, 1, 15) < substring(seq, 2, 15) THEN -1 WHEN substring(seq, 1, 15) > substring(seq, 2, 15) THEN 1 ELSE 0 END AS three_way,
    substring(seq, 4, 3) = 'ACG' AS at_three, instr(seq, 'ACGTA') > 0 AS holds, instr(seq, 'ACGTA') > 0 OR instr(seq, 'TACGT') > 0 AS holds_either, concat('G', substring(seq, 2)) AS with_g,
    substring(seq, 1, 15) = 'ACGTACGTACGTACG' OR substring(seq, 1, 15) = 'CGTACGTACGTACGT' AS same_either FROM reads"""
)
def kmer_compare(spark, d):
    return reads(spark, d).select(
        "read_id",
        dna.compare("seq", "seq", CFG.k, 0, 1).alias("three_way"),
        dna.matches_at("seq", "ACG", 3).alias("at_three"),
        dna.contains("seq", "ACGTA").alias("holds"),
        dna.contains_or_revcomp("seq", "ACGTA").alias("holds_either"),
        dna.with_base("seq", 0, "G").alias("with_g"),
        dna.matches_or_revcomp(F.substring("seq", 1, CFG.k), "ACGTACGTACGTACG").alias("same_either"),
    )


# counts


@query("SELECT * FROM good")
def quality_filter(spark, d):
    return K.good_quality(occurrences(spark, d), CFG)


@query("SELECT * FROM counts")
def extension_counts(spark, d):
    return K.extension_counts(canon(spark, d), CFG)


@query("SELECT * FROM counts")
def extension_counts_packed(spark, d):
    """By k-mers of 64 bits."""
    return superkmers.extension_counts(reads(spark, d), CFG)


@query("SELECT * FROM counts", LONG_TWO)
def extension_counts_two_words(spark, d):
    """By k-mers of two words, as more than 32 bases need."""
    return superkmers.extension_counts(reads(spark, d), LONG_TWO)


@query("SELECT * FROM counts")
def extension_counts_superkmers(spark, d):
    """By runs of k-mers of one minimizer, which are exchanged whole."""
    return superkmers.extension_counts_by_runs(reads(spark, d), CFG)


@query(
    f"""SELECT read_id, CAST(sum(length(part) - {CFG.k} + 1) AS BIGINT) AS kmers, CAST(count(*) AS BIGINT) AS stretches
    FROM (SELECT read_id, unnest(string_split(seq, 'N')) AS part FROM reads) AS p WHERE length(part) >= {CFG.k} GROUP BY read_id"""
)
def superkmer_cover(spark, d):
    """How many k-mers the runs of each read hold, and how many stretches without N these make: runs cover each k-mer once."""
    runs = superkmers.super_kmers(reads(spark, d), CFG, keep=("read_id", "s"))
    pieces = runs.groupBy("read_id").agg(F.sum("n").cast("long").alias("kmers"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("at"))
    breaks = F.filter(F.transform("at", lambda x, i: F.coalesce(F.get("at", i - 1)["s"] + F.get("at", i - 1)["n"] == x["s"], F.lit(False))), lambda same: ~same)
    return pieces.select("read_id", "kmers", F.size(breaks).cast("long").alias("stretches"))


@query("SELECT * FROM counts")
def counts_grown(spark, d):
    """Counts of half of the reads, stored in buckets, and grown by the other half."""
    rows = reads(spark, d)
    first = written(superkmers.extension_counts(rows.where("read_id % 2 = 0"), CFG), "counts")
    # tasks merge whole buckets, so these grow in number
    buckets = growing.buckets_for(first, 8)
    stored = growing.store(first, new_folder(spark, "counts"), buckets)
    return growing.grow(stored, rows.where("read_id % 2 = 1"), new_folder(spark, "counts"), CFG, buckets)


@query("SELECT * FROM counts")
def counts_streamed(spark, d):
    """Counts of a stream of FASTQ files that is stopped and started again after half of the files came."""
    rows, folder, out, state = reads(spark, d), *(new_folder(spark, x) for x in ("fastq", "counts", "state"))
    for half in range(2):
        fastq.write_fastq(rows.where(F.col("read_id") % 2 == half), f"{folder}/{half}")
        found = count_available(fastq_stream.stream_fastq(spark, folder), out, state, CFG)
    return found


_number = lambda part: f"list_reduce(list_transform(string_split({part}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda a, c: a * 4 + c)"


@query(f"SELECT DISTINCT kmer, {_number('kmer')} AS lo, {_number(rc('kmer'))} AS rc_lo, kmer < {rc('kmer')} AS smaller FROM canon")
def kmer_words(spark, d):
    """Packed k-mers, their reverse complements and order, by shifts."""
    word = packed.Kmer(F.lit(0).cast("long"), F.col("lo"), CFG.k)
    return superkmers.distinct_kmers(reads(spark, d), CFG).select("kmer", "lo", word.revcomp().lo.alias("rc_lo"), (word < word.revcomp()).alias("smaller"))


@query("SELECT * FROM masks")
def ext_masks(spark, d):
    return U.masks(K.extension_counts(canon(spark, d), CFG), CFG)


@query("SELECT * FROM ufx")
def valid_kmers(spark, d):
    return table(spark, d)


@query("SELECT * FROM ufx WHERE bit_count(lmask) = 1 AND bit_count(rmask) = 1")
def uu_kmers(spark, d):
    return U.unique_both(table(spark, d))


@query("SELECT DISTINCT kmer FROM canon")
def distinct_kmers(spark, d):
    return canon(spark, d).select("kmer").distinct()


@query("SELECT read_id, pos, kmer FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY read_id, pos) AS nth FROM canon) AS c WHERE nth > 1")
def singleton_suppressed(spark, d):
    return superkmers.without_first(reads(spark, d), CFG)


#: Slots of the sketch of the test tables.
SLOTS = 1 << 22


@query("SELECT read_id, pos, kmer FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY read_id, pos) AS nth FROM canon) AS c WHERE nth > 1")
def singletons_sketched(spark, d):
    """Like singleton_suppressed; k-mers that a sketch shows to be single leave before the exchange."""
    return sketch.repeated_of_reads(reads(spark, d), CFG, SLOTS)


@query("SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM canon GROUP BY kmer) AS c GROUP BY n")
def kmer_spectrum(spark, d):
    return K.spectrum(canon(spark, d))


# the table of unique extensions


@query("SELECT * FROM lettered")
def ufx_table(spark, d):
    return U.with_letters(table(spark, d))


@query("SELECT * FROM strands")
def ufx_both_strands(spark, d):
    return U.both_strands(U.with_letters(table(spark, d)))


@query("SELECT kmer, CAST(CASE WHEN bit_count(lmask) = 1 THEN lmask ELSE 0 END AS TINYINT) AS lmask, CAST(CASE WHEN bit_count(rmask) = 1 THEN rmask ELSE 0 END AS TINYINT) AS rmask FROM ufx")
def ufx_reload(spark, d):
    """Writes the table as tab-separated text and reads it back."""
    path = new_folder(spark, "ufx")
    tables.write_ufx(table(spark, d), path)
    return tables.read_ufx(spark, path)


# the graph


@query("SELECT * FROM nodes")
def oriented_nodes(spark, d):
    return C.oriented_nodes(table(spark, d))


@query("SELECT u, v FROM links")
def edges(spark, d):
    return C.edges(written(C.oriented_nodes(table(spark, d)), "nodes"))


@query("SELECT v AS u FROM back ANTI JOIN ahead USING (step)")
def path_heads(spark, d):
    return C.path_heads(written(C.oriented_nodes(table(spark, d)), "nodes"))


@query("SELECT u FROM ahead ANTI JOIN back USING (step)")
def path_tails(spark, d):
    return C.path_tails(written(C.oriented_nodes(table(spark, d)), "nodes"))


@query("SELECT kmer AS u, lext AS l, rext AS r FROM lettered WHERE lext IN ('A', 'C', 'G', 'T') AND rext IN ('A', 'C', 'G', 'T')")
def canonical_nodes(spark, d):
    """The nodes of the bidirected graph: half the rows of oriented_nodes."""
    return B.nodes(table(spark, d))


@query(f"SELECT kmer, kmer <= {rc('kmer')} AS canonical FROM lettered WHERE lext IN ('A', 'C', 'G', 'T') AND rext IN ('A', 'C', 'G', 'T')")
def piece_kmers(spark, d):
    """The k-mers, on the smaller strand, of the pieces that tasks make before these are joined: each node once."""
    found = B.joined_nodes(superkmers.unique_words(reads(spark, d), CFG), CFG.k)
    at = F.explode(F.sequence(F.lit(1), F.length("seq") - CFG.k + 1)).alias("i")
    return found.select("seq", at).select(dna.canonical(F.substr("seq", F.col("i"), F.lit(CFG.k))).alias("kmer"), F.lit(True).alias("canonical"))


# contigs


def letters_of(kmer: str) -> Column:
    return F.ascii(F.substring(kmer, 3, 1)) + F.ascii(F.substring(kmer, 8, 1))


def found_contigs(spark: SparkSession, d: str) -> DataFrame:
    return C.of_reads(reads(spark, d), CFG)


@query("SELECT seq, left_ext, right_ext, len FROM contigs")
def contigs(spark, d):
    return found_contigs(spark, d)


@query(f"SELECT seq, left_ext, right_ext, len FROM contigs WHERE len >= {CFG.least_length}")
def contigs_min_len(spark, d):
    return C.assemble(reads(spark, d), CFG)


@query(f"SELECT {rc('seq')} AS seq, translate(right_ext, 'ACGT', 'TGCA') AS left_ext, translate(left_ext, 'ACGT', 'TGCA') AS right_ext FROM contigs")
def contig_exts(spark, d):
    return C.reverse_contigs(found_contigs(spark, d))


@query("SELECT len, count(*) AS n FROM contigs GROUP BY len")
def contig_lengths(spark, d):
    return found_contigs(spark, d).groupBy("len").agg(F.count("*").alias("n"))


@query(f"SELECT seq, concat(right(seq, {CFG.k - 1}), right_ext) AS next_kmer FROM contigs")
def contig_ext_kmer(spark, d):
    return found_contigs(spark, d).select("seq", C.extension_kmer("seq", "right_ext", CFG.k).alias("next_kmer"))


@query("SELECT seq, instr(seq, 'ACGTA') > 0 AS holds, instr(seq, 'ACGTA') > 0 OR instr(seq, 'TACGT') > 0 AS holds_either FROM contigs")
def contig_contains(spark, d):
    return found_contigs(spark, d).select("seq", dna.contains("seq", "ACGTA").alias("holds"), dna.contains_or_revcomp("seq", "ACGTA").alias("holds_either"))


@query("SELECT seq, left_ext, right_ext, len FROM contigs")
def contig_join_two_level(spark, d):
    return C.two_level(written(table(spark, d), "ufx"), letters_of("least"), LETTER_BINS)


@query("SELECT seq, left_ext, right_ext, len FROM pieces")
def contig_pieces(spark, d):
    """Paths that stay within a bin of k-mers; piece_kmers shows what tasks make."""
    return C.local_contigs(table(spark, d), letters_of("least"), LETTER_BINS, CFG.k)


@query("SELECT seq, left_ext, right_ext, len FROM contigs", LONG)
def contig_join_minhash(spark, d):
    """In two levels, with bins by minimum hash, in which neighbours mostly share a bin."""
    return C.two_level_of_words(superkmers.unique_words(reads(spark, d), LONG), lambda word: hashing.min_hash_words(word, LONG_K) % BINS, LONG_K)


@query("SELECT seq AS value FROM contigs")
def sequence_lines(spark, d):
    """Writes the sequences as lines and reads these back."""
    path = new_folder(spark, "sequences")
    tables.write_sequences(found_contigs(spark, d), path)
    return spark.read.text(path)


@query("SELECT CAST(length(seq) AS STRING) AS value FROM contigs")
def length_lines(spark, d):
    path = new_folder(spark, "lengths")
    tables.write_lengths(found_contigs(spark, d), path)
    return spark.read.text(path)


_wrapped = "rtrim(regexp_replace(seq, '(.{%d})', '\\1' || chr(10), 'g'), chr(10))" % CFG.fasta_textwidth


@query(f"SELECT contig_id, concat('>contig ', contig_id, ' len ', len, ' left_ext ', left_ext, ' right_ext ', right_ext, chr(10), {_wrapped}) AS value FROM numbered")
def fasta_lines(spark, d):
    return C.fasta(C.with_ids(found_contigs(spark, d)), CFG)


@query("SELECT seq, left_ext, right_ext, len FROM contigs")
def contigs_bidirected(spark, d):
    """Contigs of the bidirected graph, made as rows of chunks."""
    return B.whole_contigs(superkmers.unique_words(reads(spark, d), CFG), k=CFG.k)


#: Bases of a chunk of the test tables, of which most contigs have one and the longest some.
CHUNK = B.chunk_size(CFG, 50)
_chunk = f"substring(seq, CAST(c * {CHUNK} + 1 AS INT), {CHUNK})"


@query(f"SELECT contig_id, c AS chunk, {_chunk} AS bases FROM numbered, unnest(range(0, CAST(ceil(len / {CHUNK}.0) AS BIGINT))) AS t(c)")
def contig_chunks(spark, d):
    return B.named_chunks(superkmers.unique_words(reads(spark, d), CFG), size=CHUNK, k=CFG.k).select("contig_id", "chunk", "bases")


@query(
    f"""SELECT contig_id, c AS chunk, concat(CASE WHEN c = 0 THEN concat('>contig ', contig_id, ' len ', len, ' left_ext ', left_ext, ' right_ext ', right_ext, chr(10)) ELSE '' END,
    rtrim(regexp_replace({_chunk}, '(.{{{CFG.fasta_textwidth}}})', '\\1' || chr(10), 'g'), chr(10))) AS value FROM numbered, unnest(range(0, CAST(ceil(len / {CHUNK}.0) AS BIGINT))) AS t(c)"""
)
def fasta_chunks(spark, d):
    """The lines of fasta_lines, chunk by chunk."""
    return B.fasta_lines(B.named_chunks(superkmers.unique_words(reads(spark, d), CFG), size=CHUNK, k=CFG.k), CFG)


@query(
    f"""SELECT contig_id, len, left_ext, right_ext, i AS line, substring(seq, CAST(i * {CFG.fasta_textwidth} + 1 AS INT), {CFG.fasta_textwidth}) AS bases
    FROM numbered, unnest(range(0, CAST(ceil(len / {CFG.fasta_textwidth}.0) AS BIGINT))) AS t(i)"""
)
def committed_fasta(spark, d):
    """Writes contigs as FASTA with a commit and reads their lines back."""
    rows = B.named_chunks(superkmers.unique_words(reads(spark, d), CFG), size=CHUNK, k=CFG.k)
    path = new_folder(spark, "fasta")
    committed.write_committed(rows.repartitionByRange("contig_id").sortWithinPartitions("contig_id", "chunk"), path, "fasta", CFG.fasta_textwidth)
    return committed.read_committed(spark, path, "fasta")


@query("SELECT kmer, concat(lext, rext) AS exts FROM strands")
def committed_ufx(spark, d):
    """Writes the table of both strands in two commits and reads back what was committed."""
    # written first, as each commit reads it
    rows = U.both_strands(U.with_letters(written(table(spark, d), "ufx"))).select("kmer", F.concat("lext", "rext").alias("exts"))
    path = new_folder(spark, "ufx")
    for part in (dna.is_canonical("kmer"), ~dna.is_canonical("kmer")):
        committed.write_committed(rows.where(part), path, "ufx")
    return committed.read_committed(spark, path, "ufx")


# hashes


_shingle = "list_reduce(list_transform(string_split(substring(kmer, CAST(i AS INT), 16), ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda a, c: a * 4 + c)"
_long = f"SELECT DISTINCT substring(seq, CAST(p AS INT), {LONG_K}) AS kmer FROM reads, unnest(range(1, length(seq) - {LONG_K} + 2)) AS t(p) WHERE instr(substring(seq, CAST(p AS INT), {LONG_K}), 'N') = 0"
_min_hash = f"SELECT kmer, min(CAST((CAST({_shingle} AS HUGEINT) * {hashing.KNUTH}) % 4294967296 AS BIGINT)) AS h FROM ({_long}) AS k, unnest(range(1, {LONG_K - 16 + 2})) AS t(i) GROUP BY kmer"


@query(_min_hash)
def lsh_minhash(spark, d):
    return long_kmers(spark, d).select("kmer", hashing.min_hash("kmer", LONG_K).alias("h"))


@query(f"SELECT read_id, CAST((CAST(read_id * 7919 % 4294967296 AS HUGEINT) * {hashing.KNUTH}) % 4294967296 AS BIGINT) AS h FROM reads")
def knuth_hash(spark, d):
    return reads(spark, d).select("read_id", hashing.knuth_hash(F.col("read_id") * 7919 % F.lit(1 << 32)).alias("h"))


@query(f"SELECT CAST(h % {BINS} AS INT) AS bin, count(*) AS kmers FROM ({_min_hash}) AS m GROUP BY 1")
def kmer_bin(spark, d):
    return long_kmers(spark, d).groupBy(hashing.kmer_bin(hashing.min_hash("kmer", LONG_K), BINS).alias("bin")).agg(F.count("*").alias("kmers"))


def lookup3_sql(k: int) -> str:
    """kmer and h of the distinct canonical k-mers whose whole bytes are three: the final mix over one word, then a step for each base that is left."""
    digits = lambda part: f"list_reduce(list_transform(string_split({part}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda a, c: a * 4 + c)"
    seed = (0xDEADBEEF + 3) & 0xFFFFFFFF
    steps = [f"SELECT kmer, ({digits('reverse(substring(kmer, 1, 12))')} + {seed}) & 4294967295 AS x0, CAST({seed} AS BIGINT) AS x1, CAST({seed} AS BIGINT) AS x2 FROM (SELECT DISTINCT kmer FROM canon) AS d"]
    for i, n in enumerate(hashing.FINAL_ROTATIONS):
        x, y = (2, 0, 1)[i % 3], (1, 2, 0)[i % 3]
        steps.append(", ".join(f"(xor(x{x}, x{y}) - {_rotated(f'x{y}', n)} + 4294967296) & 4294967295 AS x{x}" if j == x else f"x{j}" for j in range(3)))
    out = steps[0]
    for step in steps[1:]:
        out = f"SELECT kmer, {step} FROM ({out}) AS m"
    h = "(CAST(x2 AS HUGEINT) + CAST(x1 AS HUGEINT) * 4294967296)"
    for i in range(k - 12):
        h = f"(({h} * 33 + instr('ACGT', substring(kmer, {13 + i}, 1)) - 1) % 18446744073709551616)"
    return f"SELECT kmer, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS h FROM (SELECT kmer, {h} AS h FROM ({out}) AS f) AS g"


@query(lookup3_sql(CFG.k))
def kmer_hash_lookup3(spark, d):
    return canon(spark, d).select("kmer").distinct().select("kmer", hashing.kmer_hash("kmer").alias("h"))


_byte = lambda at: "printf('%02X', CAST(" + " + ".join(f"greatest(instr('ACGT', substring(kmer, {at + i}, 1)) - 1, 0) * {4**i}" for i in range(min(4, CFG.k - at + 1))) + " AS INT))"


@query(f"SELECT DISTINCT kmer, concat({', '.join(_byte(at) for at in range(1, CFG.k + 1, 4))}) AS packed FROM canon")
def kmer_packed(spark, d):
    return canon(spark, d).select("kmer").distinct().select("kmer", hashing.packed_hex("kmer", CFG.k).alias("packed"))


_odd_even = "SELECT DISTINCT kmer, read_id % 2 AS odd FROM occurrences"
_membership = f"""SELECT CAST(count(*) AS BIGINT) AS asked, CAST(count(e.kmer) AS BIGINT) AS members, CAST(0 AS BIGINT) AS missed, true AS within FROM ({_odd_even}) AS o
    LEFT JOIN (SELECT kmer FROM ({_odd_even}) AS x WHERE odd = 0) AS e ON e.kmer = o.kmer WHERE o.odd = 1"""


def odd_even(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """k-mers, as words, of odd reads with whether even reads have them, and those of even reads."""
    rows = written(superkmers.kmer_sets(reads(spark, d), CFG.k, F.col("read_id") % 2), "kmers")
    has = lambda bit: F.col("sets").bitwiseAND(F.lit(bit)) != 0
    return rows.where(has(2)).select("kmer", has(1).alias("there")), rows.where(has(1)).select("kmer")


def membership(rows: DataFrame, most: float) -> DataFrame:
    """Of rows (there, maybe): all, members, members that a filter missed, and whether it took at most a share `most` of the others for members."""
    wrong, others = F.count_if(~F.col("there") & F.col("maybe")), F.count_if(~F.col("there"))
    return rows.agg(F.count("*").alias("asked"), F.count_if("there").alias("members"), F.count_if(F.col("there") & ~F.col("maybe")).alias("missed"), (wrong <= most * others).alias("within"))


@query(_membership)
def bloom_membership(spark, d):
    """A filter of the k-mers of even reads, asked for those of odd reads: none missed, at most four times the nominal error. Large filters stay tables."""
    asked, even = odd_even(spark, d)
    return membership(bloom.answered(even, asked, max(1, even.count()), CFG.k), 4 * 0.001)


@query(_membership)
def bloom_growing(spark, d):
    """The same with filters that grow from a tenth of what is added, as tables: nothing goes to the driver."""
    asked, even = odd_even(spark, d)
    capacity = max(1, even.count() // 10)
    words, filters = bloom.growing(even, capacity, k=CFG.k)
    maybe = bloom.held(asked, words, filters, capacity, k=CFG.k)
    # each filter adds its share: the sum of a falling series
    return membership(maybe, 4 * sum(e for _, e in bloom.sizes(capacity, 0.001, filters)))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

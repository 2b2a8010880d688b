"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.llm import bpe, chat, clustering, crf, decontam, divergence, html_text, licenses, line_dedup, rules, simhash, suffix_dedup, warc
from contigua.llm.audit_sql import centroids_sql, divergence_sql, licenses_sql
from contigua.llm.common import new_folder, table

#: The vocabulary that texts are encoded with; the file is read where it lies and never copied.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    warc.written_archives(table(spark, sf_dir, "pages"), path)
    # payloads of responses are read whole; of revisits, which have none, only the headers
    responses = warc.read_archives(spark, path).where("record_type = 'response'")
    found = responses.unionAll(warc.read_archives(spark, path, payload=False).where("record_type = 'revisit'"))
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).cast("long")
    stored = F.col("payload").isNotNull()
    return found.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), size=3, most=2)
    return found.select("doc_id", simhash.hex_fp().alias("fingerprint"), "component_id")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return crf.scored(documents, crf.fit(crf.sample(documents, table(spark, sf_dir, "labels"))))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = rules.judged(documents, rules.learned(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *rules.BASE, "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_chat": op2_chat,
        "op3_warc": op3_warc,
        "op4_simhash": op4_simhash,
        "op5_quality_crf": op5_quality_crf,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_bpe": op8_bpe,
        "op9_decontamination": op9_decontamination,
        "op10_html": op10_html,
        "op11_centroids": op11_centroids,
        "op12_divergence": op12_divergence,
        "op13_licenses": op13_licenses,
    }


#: Lines with a word, their three-line windows, and the lines that windows after the first occurrence cover.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, text, i - 1 AS i, string_split(text, chr(10))[i] AS x
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
), wordy AS (
  SELECT doc_id, text, i, x, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS n
  FROM lines WHERE regexp_matches(x, '[^ \t\n\x0b\x0c\r]')
), windows AS (
  SELECT a.doc_id, a.text, a.i AS i1, b.i AS i2, c.i AS i3, a.x AS x1, b.x AS x2, c.x AS x3
  FROM wordy a JOIN wordy b ON b.doc_id = a.doc_id AND b.text = a.text AND b.n = a.n + 1
  JOIN wordy c ON c.doc_id = a.doc_id AND c.text = a.text AND c.n = a.n + 2
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, i1) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, text, unnest([i1, i2, i3]) AS i FROM placed WHERE nth > 1
), judged AS (
  SELECT l.doc_id, l.text, l.i, l.x, g.i IS NOT NULL AS removed, regexp_matches(l.x, '[^ \t\n\x0b\x0c\r]') AS has_word
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.text = l.text AND g.i = l.i
)
SELECT doc_id, CAST(count(*) FILTER (WHERE has_word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE removed) AS BIGINT) AS n_removed,
  coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '') AS text
FROM judged GROUP BY doc_id, judged.text
"""


#: Conversations as strings of their turns; the copies of one, and those that a longer one begins with, go.
CHAT_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), so_far AS (
  SELECT conv_id, row_number() OVER w AS place, string_agg(role || chr(1) || text, chr(2)) OVER w AS body,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '') OVER w AS shown
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), ends AS (
  SELECT conv_id, max(place) AS n FROM so_far GROUP BY conv_id
), whole AS (
  SELECT s.conv_id, s.place, s.body, s.shown, count(*) OVER (PARTITION BY s.place, s.body) AS n_copies,
    row_number() OVER (PARTITION BY s.place, s.body ORDER BY s.conv_id) AS nth
  FROM so_far s JOIN ends e ON e.conv_id = s.conv_id AND e.n = s.place
), inner_turns AS (
  SELECT DISTINCT s.place, s.body FROM so_far s JOIN ends e ON e.conv_id = s.conv_id AND s.place < e.n
)
SELECT w.conv_id, CAST(w.place AS BIGINT) AS n_turns, CAST(w.n_copies AS BIGINT) AS n_copies, w.shown AS text
FROM whole w ANTI JOIN inner_turns i ON i.place = w.place AND i.body = w.body WHERE w.nth = 1
"""

#: What the archives must give back, from the pages themselves.
WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first > page_id THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": CHAT_SQL, "op3_warc": WARC_SQL, "op6_line_dedup": LINE_DEDUP_SQL, "op11_centroids": centroids_sql(), "op12_divergence": divergence_sql(), "op13_licenses": licenses_sql()}

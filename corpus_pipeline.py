"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; docs has the columns of
documents. run() applies the stages to documents, writing each result to the shared folder and reading it again; what a stage left there
beside its result is deleted.

Defined cases are those of the operators; a stage on an empty table returns an empty one. Rows with a null doc_id
pass through line dedup unread and stay in near-dedup and decontamination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.llm import bpe, decontam, line_dedup, near_dups, rules
from contigua.llm.common import drop_written, settled, table
from contigua.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the learned rules reject."""
    learned = rules.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.kept_only(docs, learned)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines of repeated three-line windows but for the first; n_chars follows the text."""
    out = line_dedup.deduplicated(docs).drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one with the smallest doc_id, of each group of near-duplicates."""
    return near_dups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Learned rules, fingerprints, alignment and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        drop_written(before)
    return docs

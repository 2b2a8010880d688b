"""Chat formatting: collapses cumulative snapshots of conversations, then renders what is left.

Chat logs hold a conversation again and again as it grows. Each turn gets the rolling hash of all turns up to
it: the exclusive or of two 64-bit hashes of (place, role, text), a window function that holds one turn
at a time. A conversation whose last hash is that of a turn inside another one is a prefix of it and is dropped
by an anti-join; of equal conversations the smallest conv_id stays. Equal hashes are merged on both
sides before the join, so neither a common first turn nor a group of copies makes a hot key. What is left is
rendered in ChatML form.

Defined cases: turns are ordered by (turn, role, text), nulls first; repeated rows of a conversation count
once; a null role is written as "unknown" and differs from it in the hash no more, a null text is empty; conversations
with the same turns but other turn numbers are equal; rows with a null conv_id belong to no conversation
and are left out. Role and text cannot close a turn: "<|" in them is written "< |". One conversation is one output value,
so its turns meet when it is rendered; all else is combined before the shuffle. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, written

START, END = "<|im_start|>", "<|im_end|>"


def rows_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the turns, each different one once, dealt by conversation."""
    rows = df.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # dealt by conv_id, rows need no further exchange, neither to be told apart nor to be ordered
    return rows.repartition("conv_id").distinct()


def hashed(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1) and the rolling hash (p1, p2) of the turns up to this one."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(by))
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("conv_id", "place", *(F.bit_xor(F.xxhash64(F.lit(k), "place", "role", "text")).over(so_far).alias(f"p{k}") for k in (1, 2)))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no longer one begins with."""
    last = F.max_by(F.struct("place", "p1", "p2"), "place")
    ends = hashed.groupBy("conv_id").agg(last.alias("end"))
    whole = ends.groupBy(F.col("end.place").alias("place"), F.col("end.p1").alias("p1"), F.col("end.p2").alias("p2")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashed.join(ends.select("conv_id", F.col("end.place").alias("n")), "conv_id").where("place < n").select("place", "p1", "p2").distinct()
    return whole.join(inner, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def rendered(rows: DataFrame) -> DataFrame:
    """conv_id and text: all turns in ChatML form, each closed and followed by a line end."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    each = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda s: F.concat(F.lit(START), safe(s["role"]), F.lit("\n"), safe(s["text"]), F.lit(END + "\n"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(each, line), "").alias("text"))


def formatted(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of the maximal conversations of df (conv_id, turn, role, text).

    The hashes are written once, without the texts, which only meet the conversations that are kept.
    """
    prints = written(hashed(rows_of(df)), "turns")
    kept = written(maximal(prints), "conversations")
    drop_written(prints)
    return rendered(rows_of(df).join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "text")

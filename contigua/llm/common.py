"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.operators.storage import drop_written, new_folder, settled, written

__all__ = ["SPACES", "WORD_GAP", "drop_written", "joined", "new_folder", "settled", "table", "text_bytes", "written"]

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

#: A key of more rows than a HOT-th of all is hot: there are fewer than HOT such keys.
HOT = 1024


def joined(rows: DataFrame, one: DataFrame, on: str, count: str = "n", hot: int = HOT) -> DataFrame:
    """rows with the columns of `one`, which has one row a key and in `count` how many of rows have that key.

    Hot keys, fewer than `hot` by their definition, go to all tasks, so their rows stay where they are; the others meet theirs by an exchange. Both
    tables are read more than once: they should be written ones. Rows whose key `one` does not have are left out.
    """
    total = one.agg(F.sum(count)).first()[0] or 0
    few = one.where(F.col(count) > total / hot).drop(count)
    others = one.where(F.col(count) <= total / hot).drop(count)
    return rows.join(F.broadcast(few), on).unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(others, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(values: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes, null as empty, one at a time."""
    for x in values.cast(pa.binary()) if not pa.types.is_binary(values.type) else values:
        yield x.as_py() or b""

"""Line dedup by overlapping windows of three lines, in native expressions.

A window is three consecutive lines that hold a word (others are passed over), hashed from two
64-bit hashes of each line. Of each window that occurs more than once, all but the first occurrence, by (doc_id, place),
are later; the lines that later occurrences cover, merged over overlaps, are removed. What is counted is
the input, not what is left.

Only hashes and places are shuffled for counting, combined before the shuffle; the windows that occur once leave
there. Texts are joined once with the covered places of their document.

Defined cases: a null text has no lines and stays null; a text with fewer than three lines with a word is kept;
lines without a word are kept; rows with a null doc_id are kept whole and count nothing; rows with equal doc_id and
text count as one and get the same result, rows of one doc_id with different texts are ordered by the
hash of the text. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import SPACES

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _wordy(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, version, places (line numbers of the three lines) and (h1, h2) of each window."""
    numbered = F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.filter(numbered, lambda s: _wordy(s["x"])).alias("_lines"))
    rows = rows.where(F.size("_lines") >= LINES).withColumn("_h", F.transform("_lines", lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(1), s["x"]).alias("b"))))
    part = lambda i, name: [F.get(F.col("_h"), i + k)[name] for k in range(LINES)]
    each = F.transform(F.sequence(F.lit(0), F.size("_h") - LINES), lambda i: F.struct(F.array(*part(i, "i")).alias("places"), F.xxhash64(*part(i, "a")).alias("h1"), F.xxhash64(*part(i, "b")).alias("h2")))
    return rows.select("doc", "version", F.explode(each).alias("w")).select("doc", "version", "w.*")


def later_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, version and gone: the line numbers that windows which occurred before cover, merged."""
    found = windows(df, key, text)
    place = F.struct("doc", "version", F.col("places")[0].alias("at"))
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc", "version").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the text after removal, and n_lines (with a word) and n_removed, which replace columns of these names."""
    later = later_lines(df.select(key, text), key, text)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rows = df.select(row.alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = rows.join(later, (F.col("k") == F.col("doc")) & (F.col("h") == F.col("version")), "left").withColumn("split", _lines(F.col("t")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("split"), i)), "\n")
    found = {
        text: F.when(F.col("gone").isNull(), F.col("t")).otherwise(left),
        "n_lines": F.coalesce(F.size(F.filter(F.col("split"), _wordy)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    names = [*df.columns, *(c for c in found if c not in df.columns)]
    return rows.select(*(found[c].alias(c) if c in found else F.col(f"row.`{c}`").alias(c) for c in names))

"""FASTQ files: a Python data source that splits files by byte ranges.

A split owns the records that begin in its range, and finds the first one by the frame of four lines: a line that begins with @, a
sequence, a line that begins with +, and as many qualities as bases. Paths are those of pyarrow's file systems; a folder
stands for its files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "read_id string, seq string, qual string"
SPLIT_BYTES = 64 << 20
BATCH = 8192
BLOCK = 1 << 18


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Lines:
    """Lines of a file from a byte on, each with the place where it begins. Bytes are read and cut in blocks, each once."""

    def __init__(self, source, start: int):
        source.seek(start)
        self.source, self.at, self.ready, self.cut = source, start, iter(()), []

    def next(self) -> tuple[int, bytes] | None:
        while (line := next(self.ready, None)) is None:
            block = self.source.read(BLOCK)
            if not block:
                if not self.cut:
                    return None
                line, self.cut = b"".join(self.cut), []
                break
            end = block.rfind(b"\n")
            if end < 0:
                self.cut.append(block)
                continue
            self.ready = iter((b"".join(self.cut) + block[:end]).split(b"\n"))
            self.cut = [block[end + 1 :]] if end + 1 < len(block) else []
        begun = self.at
        self.at += len(line) + 1
        return begun, line.rstrip(b"\r")


def is_record(four: list[tuple[int, bytes]]) -> bool:
    head, seq, plus, qual = (x[1] for x in four)
    return head[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual)


def records(source, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """The records that begin in [start, end)."""
    lines = Lines(source, max(0, start - 1))
    if start and (first := lines.next()) is not None:
        del first  # the line that holds the byte before the range; one that begins at start is kept
    four: list[tuple[int, bytes]] = []
    synced = start == 0
    while (line := lines.next()) is not None:
        if not four and not line[1]:
            continue  # blank lines between records and at the end
        four.append(line)
        if len(four) < 4:
            continue
        if four[0][0] >= end:
            return
        if is_record(four):
            synced = True
            head, seq, _, qual = (x[1].decode("latin-1") for x in four)
            yield head[1:], seq, qual
            four.clear()
        elif synced:
            raise ValueError(f"no record of four lines at byte {four[0][0]}")
        else:
            four.pop(0)
    if four and four[0][0] < end and synced:
        raise ValueError("the file ends within a record")


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        where, root = place(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [x for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        out = [Range(f.path, s, min(f.size, s + self.split)) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        where, _ = place(self.path)
        with where.open_input_file(partition.file) as source:
            rows = []
            pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["read_id", "seq", "qual"])
            for r in records(source, partition.start, partition.end):
                rows.append(r)
                if len(rows) == BATCH:
                    yield pack()
                    rows = []
            if rows:
                yield pack()


class FastqSource(DataSource):
    """spark.read.format("fastq").option("splitBytes", n).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastqReader:
        split = next((v for k, v in self.options.items() if k.lower() == "splitbytes"), SPLIT_BYTES)
        return FastqReader(self.options["path"], int(split))


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """read_id, seq, qual of a file or a folder of files."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitBytes", split).load(path)


def total_bytes(spark: SparkSession, path: str) -> DataFrame:
    """bytes: the size of a file or of all files of a folder; their contents are not read."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_fastq(reads: DataFrame, path: str) -> None:
    """Reads (read_id, seq, qual) as FASTQ text files."""
    from pyspark.sql import functions as F

    reads.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)

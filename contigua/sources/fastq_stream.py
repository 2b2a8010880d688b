"""FASTQ files as a stream: a Python streaming source whose offsets are bytes of files.

An offset has, for each file of a folder, the byte after its last whole record, so files may be added and may grow between batches; a record that
is not whole yet waits for the next batch. A batch reads each file from the last offset to the new one, cut into ranges like those of the batch source, so
what a restart reads again is what the interrupted batch had. Files must not shrink or change where they have been read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.types import StructType

from contigua.sources.fastq import SCHEMA, SPLIT_BYTES, FastqReader, Range, is_record, place

#: Bytes at the end of a file that are searched for its last whole record first.
TAIL = 1 << 16


def whole_end(source, size: int, tail: int = TAIL) -> int:
    """The byte after the last whole record of a file of `size` bytes; 0 if there is none."""
    while size:
        start = max(0, size - tail)
        source.seek(start)
        data = source.read(size - start)
        cut = data.rfind(b"\n") + 1
        lines, at = [], start
        for line in data[:cut].split(b"\n")[:-1]:
            lines.append((at, line.rstrip(b"\r")))
            at += len(line) + 1
        if start:
            lines = lines[1:]  # may be the rest of a line
        # the records that lie one after the other up to the end, or up to the lines of one that is not whole
        for n in range(len(lines), max(3, len(lines) - 4), -1):
            four = lines[n - 4 : n]
            # a quality line may begin like a header: two records in a row, or the beginning of the file, tell
            if is_record(four) and (n == 4 and not start or n >= 8 and is_record(lines[n - 8 : n - 4])):
                return lines[n][0] if n < len(lines) else start + cut
        if not start:
            return 0
        tail *= 4
    return 0


class FastqStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        where, root = place(self.path)
        if where.get_file_info(root).type == fs.FileType.NotFound:
            return {}
        out = {}
        for f in where.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.is_file and not f.base_name.startswith(("_", ".")):
                with where.open_input_file(f.path) as source:
                    if end := whole_end(source, f.size):
                        out[f.path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        new = [(f, start.get(f, 0), end[f]) for f in sorted(end) if end[f] > start.get(f, 0)]
        return [Range(f, s, min(e, s + self.split)) for f, b, e in new for s in range(b, e, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return FastqReader(self.path, self.split).read(partition)


class FastqStreamSource(DataSource):
    """spark.readStream.format("fastq_stream").option("splitBytes", n).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "fastq_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FastqStreamReader:
        split = next((v for k, v in self.options.items() if k.lower() == "splitbytes"), SPLIT_BYTES)
        return FastqStreamReader(self.options["path"], int(split))


def stream_fastq(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """read_id, seq, qual of the files of a folder, as a stream."""
    spark.dataSource.register(FastqStreamSource)
    return spark.readStream.format("fastq_stream").option("splitBytes", split).load(path)

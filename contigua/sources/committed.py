"""Contigs and UFX tables as files with commits: a Python data source that writes FASTA or UFX text and reads back what was committed.

Each task writes one file under a fresh name. A commit adds one manifest that lists the files of the tasks that succeeded, with where each begins; a reader
takes the files of manifests only. So files of lost, repeated or aborted attempts are never read, and a write that fails leaves the table as it was. A manifest
is written under another name and then moved, so that none is seen in part.

Rows of FASTA are (contig_id, len, left_ext, right_ext, chunk, bases), chunks of contigs in lines of the configured width; they come back a line a row, as
(contig_id, len, left_ext, right_ext, line, bases), line from 0 in the file's part of a contig. Rows of UFX are (kmer, exts). Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from contigua.sources.fastq import BATCH, place

MANIFEST = "_manifest-"
FASTA = "contig_id long, len long, left_ext string, right_ext string, chunk long, bases string"
FASTA_READ = "contig_id long, len long, left_ext string, right_ext string, line long, bases string"
UFX = "kmer string, exts string"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    #: Of FASTA: contig_id, len, left_ext and right_ext of the first line, which may go on with a contig of another file.
    begin: list | None


@dataclass
class File(InputPartition):
    file: str
    begin: list | None


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, width: int):
        self.path, self.kind, self.width = path, kind, width

    def lines(self, batch: pa.RecordBatch) -> Iterator[str]:
        if self.kind == "ufx":
            yield from (f"{k}\t{e}" for k, e in zip(*(batch.column(c).to_pylist() for c in ("kmer", "exts")), strict=True))
            return
        for i, n, left, right, chunk, bases in zip(*(batch.column(c).to_pylist() for c in ("contig_id", "len", "left_ext", "right_ext", "chunk", "bases")), strict=True):
            if not chunk:
                yield f">contig {i} len {n} left_ext {left} right_ext {right}"
            yield from (bases[at : at + self.width] for at in range(0, len(bases), self.width))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        name, rows, begin = f"part-{uuid.uuid4().hex}.{'tsv' if self.kind == 'ufx' else 'fa'}", 0, None
        out = None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if out is None:
                    out = where.open_output_stream(f"{root}/{name}")
                    begin = None if self.kind == "ufx" else [b.column(c)[0].as_py() for c in ("contig_id", "len", "left_ext", "right_ext")]
                out.write("".join(f"{line}\n" for line in self.lines(b)).encode())
                rows += b.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else "", rows, begin)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        files = [{"file": m.file, "rows": m.rows, "begin": m.begin} for m in messages if m is not None and m.file]
        name = f"{MANIFEST}{uuid.uuid4().hex}.json"
        with where.open_output_stream(f"{root}/.{name}") as f:
            f.write(json.dumps({"kind": self.kind, "files": files}).encode())
        where.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        for m in messages:
            if m is not None and m.file and where.get_file_info(f"{root}/{m.file}").is_file:
                where.delete_file(f"{root}/{m.file}")


def committed_files(path: str, kind: str) -> list[File]:
    where, root = place(path)
    found = [x.path for x in where.get_file_info(fs.FileSelector(root)) if x.is_file and x.base_name.startswith(MANIFEST)]
    out = []
    for p in sorted(found):
        with where.open_input_stream(p) as f:
            told = json.loads(f.read())
        if told["kind"] != kind:
            raise ValueError(f"{path} holds {told['kind']}, not {kind}")
        out += [File(f"{root}/{x['file']}", x["begin"]) for x in told["files"]]
    return out


class CommittedReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[File]:
        return committed_files(self.path, self.kind) or [File("", None)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, _ = place(self.path)
        names = ["kmer", "exts"] if self.kind == "ufx" else ["contig_id", "len", "left_ext", "right_ext", "line", "bases"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, head, n = [], partition.begin, 0
        with where.open_input_stream(partition.file) as raw:
            if self.kind == "ufx":
                for block in _blocks(raw):
                    cells = block.decode().replace("\n", "\t").split("\t")
                    yield pa.RecordBatch.from_arrays([pa.array(cells[i::2], pa.string()) for i in range(2)], names)
                return
            for line in _lines(raw):
                if line[:1] == ">":
                    _, i, _, size, _, left, _, right = line.split(" ")
                    head, n = [int(i), int(size), left, right], 0
                else:
                    rows.append((*head, n, line))
                    n += 1
                if len(rows) == BATCH:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)


def _blocks(source) -> Iterator[bytes]:
    """Whole lines, without the last line end of each block of them."""
    rest = b""
    while block := source.read(1 << 18):
        whole, end, tail = block.rpartition(b"\n")
        if end:
            yield rest + whole
            rest = tail
        else:
            rest += block
    if rest:
        yield rest


def _lines(source) -> Iterator[str]:
    for block in _blocks(source):
        yield from block.decode().split("\n")


class CommittedSource(DataSource):
    """format("contigs").option("kind", "fasta" or "ufx").option("width", n)."""

    @classmethod
    def name(cls) -> str:
        return "contigs"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "fasta")
        if kind not in ("fasta", "ufx"):
            raise ValueError("kind is fasta or ufx")
        return kind

    def schema(self) -> str:
        return UFX if self.kind == "ufx" else FASTA_READ

    def reader(self, schema: StructType) -> CommittedReader:
        return CommittedReader(self.options["path"], self.kind)

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise ValueError("commits are added; write to another path instead")
        return CommittedWriter(self.options["path"], self.kind, int(self.options.get("width", 50)))


def write_committed(rows: DataFrame, path: str, kind: str, width: int = 50) -> None:
    """One commit of rows (FASTA or UFX, see above)."""
    rows.sparkSession.dataSource.register(CommittedSource)
    rows.write.format("contigs").option("kind", kind).option("width", width).mode("append").save(path)


def read_committed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(CommittedSource)
    return spark.read.format("contigs").option("kind", kind).load(path)

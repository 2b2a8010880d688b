"""Reads in BAM files: a Python data source that splits files by byte ranges.

A BAM file is a row of small compressed blocks, each with its size in its header. A split owns the records that begin in blocks which begin in its range. It finds
the first block by its header, checked by that of the block which follows, and the first record, for which the format has no mark, as the first place from
which records follow each other plausibly for a while, or up to the end of the file.

Rows are read_id, seq and qual as sequenced: reads that were stored from the other strand are turned back, and secondary and supplementary records are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from contigua.sources.fastq import BATCH, SCHEMA, FastqReader, Range, place

SPLIT_BYTES = 64 << 20
#: Fixed values of the format: the beginning of a block, the empty block at the end of a file, the beginning of a file, letters by their codes, and flags.
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FILE_MAGIC = b"BAM\x01"
LETTERS = "=ACMGRSVTWYHKDBN"
TURNED, LEFT_OUT = 0x10, 0x900
#: Bytes of a block before compression; records in a row that make a place plausible.
BLOCK_BYTES, IN_A_ROW = 65280, 4
FIELDS = struct.Struct("<iiiBBHHHiiii")

_paired = str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD")
_pairs = [a + b for a in LETTERS for b in LETTERS]
_codes = {c: i for i, c in enumerate(LETTERS)}


def block_size(header: bytes) -> int:
    """The size of the block that begins with some bytes; 0 if none does."""
    if len(header) < 18 or header[:4] != BLOCK_MAGIC:
        return 0
    extra, at = struct.unpack_from("<H", header, 10)[0], 12
    while at + 6 <= min(len(header), 12 + extra):
        name, n = header[at : at + 2], struct.unpack_from("<H", header, at + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + n
    return 0


def _at(source, at: int, n: int) -> bytes:
    source.seek(at)
    return source.read(n)


def first_block(source, start: int, end: int, size: int) -> int:
    """Where the first block of [start, end) begins; -1 if none does."""
    data = _at(source, start, min(size, end + 20) - start)
    at = data.find(BLOCK_MAGIC)
    while 0 <= at < end - start:
        n = block_size(data[at : at + 64])
        after = start + at + n
        if n and (after == size or block_size(_at(source, after, 64))):
            return start + at
        at = data.find(BLOCK_MAGIC, at + 1)
    return -1


def blocks(source, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The place and contents of each block from one on."""
    while at < size:
        n = block_size(_at(source, at, 64))
        if not n:
            raise ValueError(f"no block at byte {at}")
        data = _at(source, at, n)
        if len(data) < n:
            raise ValueError(f"the file ends within the block at byte {at}")
        yield at, zlib.decompress(data, 31)
        at += n


class Contents:
    """The uncompressed bytes from a block on, as far as they are asked for, and from which of them on blocks begin at or beyond `end`."""

    def __init__(self, source, at: int, end: int, size: int):
        self.more, self.end, self.data, self.begin, self.limit, self.whole = blocks(source, at, size), end, bytearray(), 0, None, False

    def upto(self, place: int) -> bool:
        """Whether there are `place` bytes."""
        while not self.whole and self.begin + len(self.data) < place:
            if (block := next(self.more, None)) is None:
                self.whole = True
                break
            if self.limit is None and block[0] >= self.end:
                self.limit = self.begin + len(self.data)
            self.data += block[1]
        return self.begin + len(self.data) >= place

    def get(self, place: int, n: int) -> bytes:
        if not self.upto(place + n):
            raise ValueError("the file ends within a record")
        return bytes(self.data[place - self.begin : place - self.begin + n])

    def drop(self, place: int) -> None:
        if place - self.begin > 1 << 20:
            del self.data[: place - self.begin]
            self.begin = place

    def owns(self, place: int) -> bool:
        """Whether a record at `place` begins in a block of the split."""
        return self.upto(place + 1) and (self.limit is None or place < self.limit)


def plausible(c: Contents, place: int) -> int:
    """The size of the record at a place, if there can be one; else 0."""
    if not c.upto(place + FIELDS.size):
        return 0
    n, ref, pos, name, _, _, ops, _, length, next_ref, next_pos, _ = FIELDS.unpack(c.get(place, FIELDS.size))
    need = FIELDS.size - 4 + name + 4 * ops + (length + 1) // 2 + length
    if not (name > 0 and 0 <= length < 1 << 28 and need <= n < 1 << 29 and min(ref, pos, next_ref, next_pos) >= -1) or not c.upto(place + FIELDS.size + name):
        return 0
    text = c.get(place + FIELDS.size, name)
    return n + 4 if text[-1] == 0 and all(33 <= x < 127 for x in text[:-1]) else 0


def first_record(c: Contents) -> int:
    """The first place of a split's bytes where records begin; -1 if none does."""
    at = 0
    while c.owns(at):
        place, n = at, 0
        while n < IN_A_ROW and (size := plausible(c, place)):
            place, n = place + size, n + 1
        if n == IN_A_ROW or n and not c.upto(place + 1) and c.upto(place):
            return at
        at += 1
    return -1


def after_header(c: Contents) -> int:
    if c.get(0, 4) != FILE_MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack("<i", c.get(4, 4))[0]
    refs, at = struct.unpack("<i", c.get(at, 4))[0], at + 4
    for _ in range(refs):
        at += 8 + struct.unpack("<i", c.get(at, 4))[0]
    return at


def records(source, start: int, end: int, size: int, offset: int) -> Iterator[tuple[str, str, str]]:
    """read_id, seq and qual of the records of a split."""
    first = first_block(source, start, end, size) if start else 0
    if first < 0:
        return
    c = Contents(source, first, end, size)
    at = first_record(c) if start else after_header(c)
    while at >= 0 and c.owns(at):
        n, _, _, name, _, _, ops, flag, length, *_ = FIELDS.unpack(c.get(at, FIELDS.size))
        body = c.get(at + FIELDS.size, n + 4 - FIELDS.size)
        if not flag & LEFT_OUT:
            s = name + 4 * ops
            seq = "".join([_pairs[x] for x in body[s : s + (length + 1) // 2]])[:length]
            quals = body[s + (length + 1) // 2 : s + (length + 1) // 2 + length]
            qual = "".join([chr(offset + (q & 255)) if q != 255 else chr(offset) for q in quals])
            if flag & TURNED:
                seq, qual = seq.translate(_paired)[::-1], qual[::-1]
            yield body[: name - 1].decode("ascii"), seq, qual
        at += n + 4
        c.drop(at)


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int, offset: int):
        self.path, self.split, self.offset = path, split, offset

    def partitions(self) -> list[Range]:
        return FastqReader(self.path, self.split).partitions()

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        where, _ = place(self.path)
        size = where.get_file_info(partition.file).size
        with where.open_input_file(partition.file) as source:
            rows = []
            pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["read_id", "seq", "qual"])
            for r in records(source, partition.start, partition.end, size, self.offset):
                rows.append(r)
                if len(rows) == BATCH:
                    yield pack()
                    rows = []
            if rows:
                yield pack()


class BamSource(DataSource):
    """spark.read.format("bam").option("splitBytes", n).option("qualityOffset", n).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        given = {k.lower(): v for k, v in self.options.items()}
        return BamReader(self.options["path"], int(given.get("splitbytes", SPLIT_BYTES)), int(given.get("qualityoffset", 64)))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT_BYTES, offset: int = 64) -> DataFrame:
    """read_id, seq, qual of a file or a folder of files; qualities are characters from `offset` on, as those of FASTQ files."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split).option("qualityOffset", offset).load(path)


def encoded(read_id: str, seq: str, qual: str, offset: int, flag: int = 4) -> bytes:
    """The record of an unmapped read."""
    name = read_id.encode("ascii") + b"\x00"
    codes = [_codes[c] for c in seq] + [0] * (len(seq) % 2)
    body = name + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(ord(q) - offset for q in qual)
    return FIELDS.pack(FIELDS.size - 4 + len(body), -1, -1, len(name), 0, 4680, 0, flag, len(seq), -1, -1, 0) + body


def block(data: bytes) -> bytes:
    """A compressed block of up to BLOCK_BYTES bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return BLOCK_MAGIC + bytes.fromhex("0000000000ff") + struct.pack("<H2sHH", 6, b"BC", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(reads: DataFrame, path: str, offset: int = 64, block_bytes: int = BLOCK_BYTES) -> None:
    """Reads (read_id, seq, qual) as a folder of BAM files, one for each task that has reads. Files show once all tasks have ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = place(path)
        where.create_dir(root, recursive=True)
        name, out, held = f"part-{uuid.uuid4().hex}.bam", None, bytearray()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = where.open_output_stream(f"{root}/.{name}")
                    held += FILE_MAGIC + struct.pack("<ii", 0, 0)
                held += encoded(*row, offset)
                while len(held) >= block_bytes:
                    out.write(block(bytes(held[:block_bytes])))
                    del held[:block_bytes]
        if out is not None:
            if held:
                out.write(block(bytes(held)))
            out.write(LAST_BLOCK)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    rows = reads.select(*(reads[c].cast("string").alias(c) for c in ("read_id", "seq", "qual")))
    names = [r["name"] for r in rows.mapInArrow(run, "name string").collect()]
    where, root = place(path)
    where.create_dir(root, recursive=True)
    for name in names:
        where.move(f"{root}/.{name}", f"{root}/{name}")

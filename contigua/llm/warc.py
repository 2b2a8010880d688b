"""WARC archives: a Python data source ("warc") that writes and reads them.

Writing: each task writes archives of its own, a gzip member for each record, and beside each archive the places of its members;
a commit adds a manifest that names the archives of its tasks that ended well, so repeated or lost attempts leave nothing that a
reader takes, and appended archives add up. Reading: archives are cut between members into partitions of like size; a record's headers
are parsed first, and a payload that pushed-down predicates or the option payload=false rule out is neither inflated nor read: the reader
goes to the next member. Archives from elsewhere, without such places, are read from end to end.

Columns: record_id, record_type, target_uri, date, payload_digest (bare hex SHA-1 of the full payload),
payload_bytes, refers_to (strings), payload (binary, null unless it was read). A revisit record has no payload of its own; its
digest and length are those of the payload that it refers to.

Predicates that are pushed down: equality, IN and IS NOT NULL on record_type, record_id, target_uri, payload_digest and refers_to.

Defined cases: a null or empty page has an empty payload; an empty table makes no archive and reads
as no rows; records that end early make the reader fail, whether their payload is wanted or not. Paths are those of pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from contigua.llm.common import drop_written, joined, settled, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
PUSHED = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")
#: Manifests have this prefix and the suffix .json; an archive's file of places has the archive's name and this suffix.
MANIFEST, PLACES = "_manifest-", ".places"
ARCHIVE_BYTES = 256 << 20
#: Bytes that are read at once, and inflated at once where headers are looked for.
CHUNK, HEAD = 1 << 16, 1 << 11
#: Bytes of archives that one partition reads at most and, where that leaves cores idle, at least.
PARTITION_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Bytes of an archive after which a partition may be cut: the driver holds the places of these cuts, not those of all members.
CUT_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
#: Payloads shorter than this are not worth a revisit record.
REVISIT_BYTES = 1000


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def clean(value: str) -> str:
    """A header value cannot hold line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row) -> bytes:
    """A WARC record of a row with the columns of SCHEMA."""
    payload = bytes(row.payload or b"") if row.record_type == "response" else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode() + payload
    fields = {
        "WARC-Type": row.record_type,
        "WARC-Record-ID": f"<{clean(row.record_id)}>",
        "WARC-Date": row.date,
        "WARC-Target-URI": clean(row.target_uri or ""),
        "WARC-Payload-Digest": f"sha1:{base32(row.payload_digest)}",
        "WARC-Refers-To": f"<{clean(row.refers_to)}>" if row.refers_to is not None else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row.record_type == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, list[int]]]  # name, bytes, places between which partitions may be cut


class Archive:
    """An archive that is being written."""

    def __init__(self, where: fs.FileSystem, root: str, cut: int):
        self.where, self.path, self.cut = where, f"{root}/part-{uuid.uuid4().hex}.warc.gz", cut
        self.out, self.places = where.open_output_stream(self.path, compression=None), [0]

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.places.append(self.places[-1] + len(data))

    @property
    def size(self) -> int:
        return self.places[-1]

    def close(self) -> tuple[str, int, list[int]]:
        self.out.close()
        with self.where.open_output_stream(self.path + PLACES, compression=None) as out:
            out.write(np.array(self.places, "<i8").tobytes())
        cuts = [0]
        for p in self.places:
            if p - cuts[-1] >= self.cut:
                cuts.append(p)
        return self.path.rsplit("/", 1)[1], self.size, cuts


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, cut: int = CUT_BYTES):
        self.path, self.cut = path, cut

    def write(self, iterator: Iterator) -> Written:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        files, now = [], None
        for row in iterator:
            if now is not None and now.size >= ARCHIVE_BYTES:
                files.append(now.close())
                now = None
            now = now or Archive(where, root, self.cut)
            now.add(member(record(row)))
        if now is not None:
            files.append(now.close())
        return Written(files)

    def commit(self, messages: list) -> None:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m is not None for f in m.files)).encode())

    def abort(self, messages: list) -> None:
        where, root = place(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else ():
                where.delete_file(f"{root}/{name}")
                where.delete_file(f"{root}/{name}{PLACES}")


class Buffered:
    """A file that is read in pieces of CHUNK bytes; places in the piece that is held cost nothing to go to."""

    def __init__(self, source):
        self.source, self.at, self.held, self.base, self.size = source, 0, b"", 0, source.size()

    def read(self, n: int) -> bytes:
        if not self.base <= self.at < self.base + len(self.held):
            self.held, self.base = self.source.read_at(max(n, CHUNK), self.at), self.at
        out = self.held[self.at - self.base : self.at - self.base + n]
        self.at += len(out)
        return out


class Stream:
    """Bytes of an archive up to a place, inflated where it is gzip; skip() keeps nothing."""

    def __init__(self, source: Buffered, packed: bool, end: int):
        self.source, self.end, self.held, self.inflate = source, end, b"", zlib.decompressobj(31) if packed else None

    def raw(self) -> bytes:
        return self.source.read(min(CHUNK, self.end - self.source.at)) if self.source.at < self.end else b""

    def more(self, most: int = 4 * CHUNK) -> bool:
        while True:
            if self.inflate is not None and self.inflate.eof:
                rest = self.inflate.unused_data or self.raw()
                if not rest:
                    return False
                self.inflate = zlib.decompressobj(31)
            else:
                rest = self.inflate.unconsumed_tail if self.inflate is not None else b""
                rest = rest or self.raw()
                if not rest:
                    return False
            got = rest if self.inflate is None else self.inflate.decompress(rest, most)
            if got:
                self.held += got
                return True

    def head(self) -> bytes:
        """Up to the next empty line, without it; empty at the end."""
        at = 0
        while (i := self.held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.held)
            if not self.more(HEAD):
                if self.held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return b""
        out, self.held = self.held[:i], self.held[i + 4 :]
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            parts.append(self.held[:left])
            self.held = self.held[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            if not self.held and self.inflate is None:
                self.source.at += n  # the payload is not even read
                if self.source.at > self.end:
                    raise ValueError("the archive ends within a record")
                return
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            gone = min(n, len(self.held))
            self.held = self.held[gone:]
            n -= gone


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(stream: Stream, wanted: dict[str, frozenset], there: set[str], with_payload: bool, alone: bool = False) -> Iterator[tuple]:
    """Rows of the records whose headers meet the predicates; of one that stands alone nothing is skipped that is not needed."""
    while head := stream.head():
        h = fields(head)
        left = int(h["content-length"])
        strip = lambda x: x[1:-1] if x and x[0] == "<" else x
        digest = h.get("warc-payload-digest", "").partition(":")[2]
        row = {"record_id": strip(h.get("warc-record-id")), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to": strip(h.get("warc-refers-to"))}
        row["payload_digest"] = base64.b32decode(digest).hex() if digest else None
        if all(row[c] in v for c, v in wanted.items()) and all(row[c] is not None for c in there):
            payload, size = None, None
            if h.get("content-type", "").startswith("application/http"):
                before = stream.head()
                left -= len(before) + 4
                size = int(fields(before).get("content-length", left))
            if with_payload and row["record_type"] != "revisit":
                payload = stream.take(left + 4)[:left]
                left = -4
            row |= {"payload": payload, "payload_bytes": len(payload) if payload is not None and size is None else left if size is None else size}
            yield tuple(row[c] for c in COLUMNS)
        if alone:
            return
        stream.skip(left + 4)


@dataclass
class Archives(InputPartition):
    parts: list[tuple[str, int, int]]  # file, from, to; to is -1 where the file has no places of members


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, tasks: int = 1):
        self.path, self.with_payload, self.tasks, self.wanted, self.there = path, with_payload, tasks, {}, set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                name = f.attribute[0]
                self.wanted[name] = frozenset(values) & self.wanted.get(name, frozenset(values))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.there.add(f.attribute[0])
            else:
                yield f

    def partitions(self) -> list[Archives]:
        where, root = place(self.path)
        there = {x.base_name: x for x in where.get_file_info(fs.FileSelector(root))}
        cuts: list[tuple[str, int, int, int]] = []  # file, from, to, bytes
        if manifests := [n for n in there if n.startswith(MANIFEST)]:
            for m in sorted(manifests):
                with where.open_input_stream(f"{root}/{m}", compression=None) as f:
                    for name, size, at in json.loads(f.read()):
                        cuts += [(name, s, e, e - s) for s, e in zip(at, [*at[1:], size], strict=True) if s < e]
        else:
            cuts = [(n, 0, -1, x.size) for n, x in sorted(there.items()) if n.endswith((".warc", ".warc.gz"))]
        most = min(PARTITION_BYTES, max(LEAST_BYTES, sum(c[3] for c in cuts) // self.tasks))
        out, size = [Archives([])], 0
        for name, s, e, n in cuts:
            if size + n > most and out[-1].parts:
                out.append(Archives([]))
                size = 0
            path = f"{root}/{name}"
            if out[-1].parts and out[-1].parts[-1][::2] == (path, s):
                out[-1].parts[-1] = (path, out[-1].parts[-1][1], e)
            else:
                out[-1].parts.append((path, s, e))
            size += n
        return out

    def rows(self, where: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple]:
        rule = (self.wanted, self.there, self.with_payload)
        with where.open_input_file(path) as f:
            source, packed = Buffered(f), path.endswith(".gz")
            if end < 0:
                yield from parse(Stream(source, packed, source.size), *rule)
                return
            if source.size < end:
                raise ValueError(f"the archive ends within a record: {path}")
            with where.open_input_stream(path + PLACES, compression=None) as p:
                places = np.frombuffer(p.read(), "<i8")
            places = places[(places >= start) & (places <= end)].tolist()
            for s, e in zip(places, places[1:], strict=False):
                source.at = s
                yield from parse(Stream(source, packed, e), *rule, alone=True)

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_bytes" else pa.string()) for c in COLUMNS])
        where, _ = place(self.path)
        rows, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for part in partition.parts:
            for row in self.rows(where, *part):
                rows.append(row)
                size += 200 + len(row[-1] or b"")
                if size >= BATCH_BYTES:
                    yield pack()
                    rows, size = [], 0
        if rows:
            yield pack()


class WarcSource(DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("tasks", "1")))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("cut", CUT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def payloads(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(page).cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))


def repeats(pages: DataFrame, key: str = "page_id", page: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """key and first: of equal payloads of at least `least` bytes, the largest key for each smaller one. Payloads are not shuffled, and read once; digests are written."""
    rows = payloads(pages, key, key, page)
    large = rows.where((F.octet_length("payload") >= least) & F.col("key").isNotNull())
    digests = written(large.select("key", F.unhex(F.sha1("payload")).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.max("key").alias("first"), F.min("key").alias("last"), F.count("*").alias("n")).where("last < first").select("digest", "first", "n")
    return joined(digests, written(first, "firsts"), "digest").where("key < first").select("key", "first").groupBy("key").agg(F.max("first").alias("first"))


def records(pages: DataFrame, again: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows of SCHEMA for pages, those that `again` (of repeats()) names as revisits.

    A null key is a response of its own; rows of the largest key that repeat it are responses too.
    """
    rows = payloads(pages, key, url, page).join(again, "key", "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= least)
    return rows.select(
        F.coalesce(urn(F.col("key")), F.lit("urn:page:")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.sha1("payload").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def written_archives(pages: DataFrame, path: str, cut: int = CUT_BYTES) -> None:
    """Appends an archive of the pages. The repeats are written first, so that few of them need no exchange of the pages."""
    register(pages.sparkSession)
    again = settled(pages.sparkSession, lambda: repeats(pages), "repeats")
    records(pages, again).write.format("warc").mode("append").option("cut", cut).save(path)
    drop_written(again)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()

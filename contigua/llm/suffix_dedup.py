"""Exact removal of long repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Each byte that is covered by a string of LENGTH bytes which also starts anywhere else is removed. The suffixes that are sorted
are those at anchors. The anchor of a window of LENGTH bytes is the place of the smallest hash of CORE bytes in it, leftmost on ties:
the window's content alone decides it, so equal windows have their anchors at equal places. The windows of one
anchor are a zone: starts from `first` on, `span` + 1 of them.

1. A map finds zones and the hashes of their cores and of their whole strings.
2. Zones with equal strings are counted, combined before the shuffle: all their windows are repeated. A core that occurs
   once settles its zone as well: nothing in it is repeated. Both are what is known from distinguishing prefixes.
3. Of each other core the different zone strings, one of each, go to the merge sort: each task sorts what it
   holds by (core hash, suffix from the anchor), writes front-coded runs, each string as the length of its common prefix with
   the one before and the rest, and sends them by range of core hash. Loser trees merge the runs; a string in
   the tree carries its common prefix with the last winner, so known prefixes are never compared again.
   The common prefixes that come out, with those of the bytes before the anchors, tell which windows are equal.
4. Intervals of repeated starts meet their text once and become the removed runs.

Cores with more than GROUP different zone strings go another way instead of 3: the digests of their windows
are counted, combined before the shuffle; so no task holds a group that grows with the data.

Defined cases: a null text is the empty text; texts shorter than LENGTH lose nothing; matches never
cross rows; rows that repeat a doc_id and text are copies of each other and are removed whole where they are long
enough; a null doc_id is a value like others. Strings are judged on the input, not on what is left. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, text_bytes, written

LENGTH = 400
CORE = 128
#: Most different strings of a core that one task sorts out.
GROUP = 20_000
#: Bytes of strings that a run is made of, and of front-coded runs that one task merges, about.
RUN_BYTES = 24 << 20
MERGE_BYTES = 48 << 20
#: Window starts that are hashed at once.
PART = 1 << 21

_ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=4)
def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, modulo 2**64."""
    return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def zones(data: bytes, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, before (bytes from first to the anchor), span, core hash and string hash of each zone.

    Texts are taken in parts; a zone that a part's end cuts is two zones, which changes no window's anchor.
    """
    found = [_zones(data[p : p + PART + length - 1], p, length, core) for p in range(0, max(0, len(data) - length + 1), PART)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5


def _zones(data: bytes, shift: int, length: int, core: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    size = 1 << max(14, n.bit_length())
    (p1, i1), (p2, i2) = (_tables(b, size) for b in _ODD)
    a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    s1 = np.zeros(n + 1, np.uint64)
    np.cumsum(a * i1[:n], out=s1[1:])
    h = _mixed((s1[core:] - s1[:-core]) * p1[: n - core + 1])
    wide = length - core + 1  # cores of a window
    low = np.uint64((1 << wide.bit_length()) - 1)
    blocks = -(-len(h) // wide)
    padded = np.full(blocks * wide, ~np.uint64(0))
    padded[: len(h)] = h
    # smallest cores up to and from each place of a block; the low bits give way to the place
    keyed = (padded & ~low).reshape(blocks, wide) | np.arange(wide, dtype=np.uint64)
    ahead = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(keyed, axis=1).ravel()
    start = np.arange(n - length + 1)
    end = start + wide - 1
    left, right = ahead[start], behind[end]
    anchor = np.where((left & ~low) <= (right & ~low), start // wide * wide + (left & low).astype(np.int64), end // wide * wide + (right & low).astype(np.int64))
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    s2 = np.zeros(n + 1, np.uint64)
    np.cumsum(a * i2[:n], out=s2[1:])
    whole = _mixed((s2[last + length] - s2[first]) * p2[first])
    x = anchor[first]
    return first + shift, x - first, last - first, h[x].view(np.int64), whole.view(np.int64)


def once_each(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """first, shape, core, whole and times of the different zones of a text.

    A text that repeats a word over and over has one zone again and again: it is passed on once, with times 2, and its
    starts, merged, as rows of times 0, from first to whole.
    """
    first, before, span, h, whole = (np.asarray(x, np.int64) for x in found)
    shape = before * 1024 + span
    order = np.lexsort((first, shape, whole, h))
    new = np.ones(len(first), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (shape, whole, h)], axis=0)
    if new.all():
        return first, shape, h, whole, np.ones(len(first), np.int64)
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    times = np.where(many, 2, 1)
    again = order[many[group]]
    low = np.sort(first[again])
    high = (first + span)[again][np.argsort(first[again], kind="stable")]
    cut = np.r_[True, low[1:] > high[:-1] + 1]
    runs = np.flatnonzero(cut)
    ends = np.r_[runs[1:], len(low)] - 1
    kept = order[new]
    zero = np.zeros(len(runs), np.int64)
    return tuple(np.concatenate(x) for x in ((first[kept], low[runs]), (shape[kept], zero), (h[kept], zero), (whole[kept], high[ends]), (times, zero)))


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`."""
    most = min(len(a), len(b))
    step = 16
    while at < most and a[at : at + step] == b[at : at + step]:
        at = min(most, at + step)
        step *= 4
    if at >= most:
        return most
    x, y = a[at : at + step], b[at : at + step]
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return at + (n if not differ else n - (differ.bit_length() + 7) // 8)


def front_coded(items: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A run of sorted (string, rest): each with the length of its common prefix with the string before."""
    out, before = [], b""
    for s, rest in items:
        k = common_prefix(before, s)
        out += (k.to_bytes(2, "big"), (len(s) - k).to_bytes(2, "big"), len(rest).to_bytes(2, "big"), s[k:], rest)
        before = s
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(common prefix with the string before, string, rest) of a run."""
    at, s, view = 0, b"", memoryview(run)
    while at < len(run):
        k, n, m = (int.from_bytes(view[at + 2 * i : at + 2 * i + 2], "big") for i in range(3))
        at += 6
        s = s[:k] + bytes(view[at : at + n])
        yield k, s, bytes(view[at + n : at + n + m])
        at += n + m


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """The strings of front-coded runs in order, each with its common prefix with the one before, by a loser tree.

    A waiting string's prefix is always the one it shares with the last winner. Of two, the one that shares more is
    smaller; only where they share as much are bytes compared, from there on.
    """
    sources = [decoded(r) for r in runs]
    n = 1 << max(0, len(sources) - 1).bit_length()
    heads: list[tuple[int, bytes, bytes] | None] = [next(s, None) for s in sources] + [None] * (n - len(sources))
    shared = [0] * n

    def beats(i: int, j: int) -> bool:
        """Whether i comes before j; the loser's prefix becomes that with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        k = common_prefix(a[1], b[1], shared[i])
        first = a[1][k:] <= b[1][k:] if k < len(a[1]) and k < len(b[1]) else len(a[1]) <= len(b[1])
        shared[j if first else i] = k
        return first

    losers = [0] * n
    winners = [0] * n + list(range(n))
    for p in range(n - 1, 0, -1):
        i, j = winners[2 * p], winners[2 * p + 1]
        winners[p], losers[p] = (i, j) if beats(i, j) else (j, i)
    now = winners[1]
    while heads[now] is not None:
        _, s, rest = heads[now]
        yield shared[now], s, rest
        heads[now] = following = next(sources[now], None)
        if following is not None:
            shared[now] = following[0]
        p = (n + now) >> 1
        while p:
            if not beats(now, losers[p]):
                now, losers[p] = losers[p], now
            p >>= 1


#: One zone string of a core: the bytes before the anchor, last first; most and fewest of them in a window; whether it is settled; an id.
Entry = tuple[bytes, int, int, bool, tuple]


def repeated(prefixes: list[int], entries: list[Entry], length: int) -> Iterator[tuple[int, int, int]]:
    """(entry, most, fewest) bytes before the anchor, of windows that another entry has as well; intervals may overlap.

    Entries are in the order of their suffixes from the anchor; prefixes[i]: what entries i - 1 and i share of these.
    """
    n = len(entries)
    if n <= 48:
        for i in range(n):
            right = length
            for j in range(i + 1, n):
                right = min(right, prefixes[j])
                a, b = entries[i], entries[j]
                low, high = max(length - right, a[2], b[2]), min(a[1], b[1])
                if low <= high and not (a[3] and b[3]) and (high := min(high, common_prefix(a[0], b[0]))) >= low:
                    yield i, high, low
                    yield j, high, low
        return
    share = np.array(prefixes)
    order = sorted(range(n), key=lambda i: entries[i][0])
    before = np.array([0] + [common_prefix(entries[i][0], entries[j][0]) for i, j in zip(order, order[1:], strict=False)])
    most, fewest = (np.array([e[k] for e in entries]) for k in (1, 2))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    hits: list[list[int]] = [[] for _ in range(n)]
    for k in range(int(fewest.min()), int(most.max()) + 1):
        some = np.flatnonzero((fewest <= k) & (k <= most))
        key = np.cumsum(share < length - k)[some] * n + np.cumsum(before < k)[inverse[some]]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        for i in some[count[which] > 1].tolist():
            hits[i].append(k)
    for i, ks in enumerate(hits):
        start = 0
        for z in range(1, len(ks) + 1):
            if z == len(ks) or ks[z] != ks[z - 1] + 1:
                yield i, ks[z - 1], ks[start]
                start = z


_RUN = "bucket int, run binary"


def _strings(needed: DataFrame, texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Sorted, front-coded runs of the zone strings that are needed; windows' digests where a core has too many.

    needed: doc, version, zs (array of first, before, span, core, single); rows of texts: doc, version, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort()
            out: dict[int, list] = {}
            for bucket, s, rest in held:
                out.setdefault(bucket, []).append((s, rest))
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([front_coded(x) for x in out.values()], pa.binary())], ["bucket", "run"])

        for b in batches:
            for key, text, zs in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2), strict=True):
                for z in zs.as_py():
                    first, before, span, core = z["first"], z["before"], z["span"], z["core"]
                    x, end = first + before, first + span + length
                    s = (core % (1 << 64)).to_bytes(8, "big") + text[x:end]
                    left = text[first:x][::-1]
                    rest = b"".join((len(left).to_bytes(2, "big"), left, span.to_bytes(2, "big"), bytes([z["single"]]), first.to_bytes(6, "big"), key))
                    held.append((core % buckets, s, rest))
                    size += len(s) + len(rest) + 100
                if size >= RUN_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    rows = texts.join(needed, texts["doc"].eqNullSafe(needed["d"]) & (texts["version"] == needed["v"]))
    key = F.encode(F.to_json(F.struct("doc", "version")), "UTF-8")
    return rows.select(key.alias("key"), "text", "zs").mapInArrow(run, _RUN)


def _merge(runs: DataFrame, kind: str, length: int, buckets: int) -> DataFrame:
    """key (of a text) and low, high (starts of repeated windows) of unsettled zones, from runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(bucket, []).append(blob)
        for bucket in sorted(by):
            out: list[tuple[bytes, int, int]] = []
            prefixes: list[int] = []
            entries: list[Entry] = []

            def settle() -> None:
                for i, high, low in repeated(prefixes, entries, length):
                    _, _, _, settled, (first, before, key) = entries[i]
                    if not settled:
                        out.append((key, first + before - high, first + before - low))

            for k, s, rest in merged(by.pop(bucket)):
                if k < 8 and entries:
                    settle()
                    prefixes.clear()
                    entries.clear()
                n = int.from_bytes(rest[:2], "big")
                left, rest = rest[2 : 2 + n], rest[2 + n :]
                span, single, first, key = int.from_bytes(rest[:2], "big"), rest[2], int.from_bytes(rest[3:9], "big"), rest[9:]
                prefixes.append(max(0, k - 8) if entries else 0)
                entries.append((left, n, max(0, n - span), not single, (first, n, key)))
            settle()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "low", "high"])

    found = runs.repartition(buckets, "bucket").mapInArrow(run, "key binary, low long, high long")
    key = F.from_json(F.decode("key", "UTF-8"), f"doc {kind}, version long")
    return found.select(key.alias("k"), "low", "high").select("k.doc", "k.version", "low", "high")


def _windows(needed: DataFrame, texts: DataFrame, kind: str, length: int) -> DataFrame:
    """doc, version, start and digest of each window of the zones that are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, zs) in enumerate(zip(text_bytes(b.column(2)), b.column(3), strict=True)):
                starts = [(s, z["count"]) for z in zs.as_py() for s in range(z["first"], z["first"] + z["span"] + 1)]
                for at in range(0, len(starts), 10_000):
                    part = starts[at : at + 10_000]
                    digest = [hashlib.blake2b(text[s : s + length], digest_size=16).digest() for s, _ in part]
                    row = pa.array([i] * len(part))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array([s for s, _ in part], pa.int64()), pa.array(digest, pa.binary()), pa.array([c for _, c in part], pa.int64())], ["doc", "version", "start", "digest", "n"])

    rows = texts.join(needed, texts["doc"].eqNullSafe(needed["d"]) & (texts["version"] == needed["v"]))
    return rows.select("doc", "version", "text", "zs").mapInArrow(run, f"doc {kind}, version long, start long, digest binary, n long")


def _by_text(zs: DataFrame) -> DataFrame:
    """Zones gathered by the text of their sample, d and v."""
    z = F.struct(F.col("one.first").alias("first"), (F.col("shape") / 1024).cast("int").alias("before"), (F.col("shape") % 1024).cast("int").alias("span"), "core", (F.col("n") == 1).cast("int").alias("single"), F.col("n").alias("count"))
    return zs.groupBy(F.col("one.doc").alias("d"), F.col("one.version").alias("v")).agg(F.collect_list(z).alias("zs"))


def repeated_starts(texts: DataFrame, length: int = LENGTH, core: int = CORE, group: int = GROUP) -> DataFrame:
    """doc, version and starts, the intervals (low, high) of the starts of repeated windows; texts: doc, version, text."""
    if not 0 < core <= length or length - core >= 1024:
        raise ValueError("core must be positive and at most 1023 shorter than length")
    kind = texts.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [once_each(zones(t, length, core)) for t in text_bytes(b.column(2))]
            take = pa.array(np.repeat(np.arange(b.num_rows), [len(z[0]) for z in found]))
            first, shape, h, whole, times = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(first), pa.array(shape.astype(np.int32)), pa.array(h), pa.array(whole), pa.array(times.astype(np.int32))], ["doc", "version", "first", "shape", "core", "whole", "times"])

    found = written(texts.select("doc", "version", "text").mapInArrow(find, f"doc {kind}, version long, first long, shape int, core long, whole long, times int"), "zones")
    every = found.where("times > 0")
    same = written(every.groupBy("core", "whole", "shape").agg(F.sum("times").alias("n"), F.min(F.struct("doc", "version", "first")).alias("one")), "zones")
    cores = same.groupBy("core").agg(F.count("*").alias("strings"), F.min("n").alias("least")).where("strings > 1 and least = 1")
    open_zones = written(same.join(cores, "core"), "zones")
    # starts that repeat within a text, and zones that occur again as a whole
    parts = [found.where("times = 0").select("doc", "version", F.col("first").alias("low"), F.col("whole").alias("high"))]
    twice = same.where("n > 1").select("core", "whole", "shape")
    parts.append(every.join(twice, ["core", "whole", "shape"]).select("doc", "version", F.col("first").alias("low"), (F.col("first") + F.col("shape") % 1024).alias("high")))
    number, hot = open_zones.agg(F.count_if(F.col("strings") <= group), F.count_if(F.col("strings") > group)).first()
    needed: list[DataFrame] = []
    if number:
        buckets = max(1, min(4096, -(-number * (2 * length) // MERGE_BYTES)), min(number // 1000, 2 * texts.sparkSession.sparkContext.defaultParallelism))
        # written first: its size is known when the join is planned, and a small one needs no exchange of the texts
        needed.append(written(_by_text(open_zones.where(F.col("strings") <= group)), "needed"))
        runs = _strings(needed[-1], texts, length, buckets)
        parts.append(_merge(runs, kind, length, buckets))
    if hot:
        needed.append(written(_by_text(open_zones.where(F.col("strings") > group)), "needed"))
        each = written(_windows(needed[-1], texts, kind, length), "windows")
        again = each.groupBy("digest").agg(F.sum("n").alias("all")).where("all > 1").select("digest")
        parts.append(each.where("n = 1").join(again, "digest").select("doc", "version", F.col("start").alias("low"), F.col("start").alias("high")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    out = written(out.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "high")).alias("starts")), "starts")
    for x in (found, same, open_zones, *needed):
        drop_written(x)
    if hot:
        drop_written(each)
    return out


def removed_runs(starts: Iterable[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) that windows with these starts cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(starts):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + length))
        else:
            out.append((low, high + length))
    return out


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, core: int = CORE, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary: the bytes that are left) of each row."""
    kind = df.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = df.select(F.col(key).alias("doc"), body.alias("text")).select("doc", F.xxhash64("text").alias("version"), "text")
    starts = repeated_starts(texts, length, core, group)
    rows = texts.join(starts.select(F.col("doc").alias("d"), F.col("version").alias("v"), "starts"), texts["doc"].eqNullSafe(F.col("d")) & (texts["version"] == F.col("v")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, spans, digests, kept = [], [], [], [], []
            for data, found in zip(text_bytes(b.column(1)), b.column(2), strict=True):
                runs = removed_runs(((x["low"], x["high"]) for x in found.as_py()), length) if found.is_valid else []
                left, at = [], 0
                for begin, end in runs:
                    left.append(data[at:begin])
                    at = end
                left.append(data[at:])
                rest = b"".join(left)
                sizes.append(len(data))
                gone.append(len(data) - len(rest))
                spans.append(len(runs))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.select("doc", "text", "starts").mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("key", key)
    return out if with_text else out.drop("kept")

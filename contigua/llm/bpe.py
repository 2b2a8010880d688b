"""Byte-level BPE encoding and decoding.

Each pre-token is a doubly linked list of symbols; a heap holds the merge ranks of adjacent pairs. The
lowest rank (leftmost on ties) is applied and its neighbours are queued; heap entries whose symbols have
changed since are stale and are skipped. Decoding concatenates the byte strings of the vocabulary.

Defined cases: a null text is the empty text; an empty text has no tokens; special tokens' strings in a
text are encoded as these tokens, longest match first from the left, as the tokenizer file says. Rows are independent: repeated rows give
repeated results, and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that splits a text before byte-level merges.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens remembered by each Python worker; all are forgotten when so many are held.
CACHE_ENTRIES = 300_000
#: Pre-tokens longer than this many characters are encoded anew each time.
CACHE_CHARS = 64


def byte_letters() -> dict[int, str]:
    """The printable letter by which a vocabulary file writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letter = byte_letters()
        byte = {c: b for b, c in letter.items()}
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.base = [vocab[letter[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in vocab.items():
            self.strings[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        for s, i in special.items():
            self.strings[i] = s.encode()
        self.special = special
        names = sorted(special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        base, merges = self.base, self.merges
        symbols = [base[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return tuple(symbols)
        heap = []
        for i in range(n - 1):
            if (m := merges.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        if not heap:
            return tuple(symbols)
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, a, b, joined = pop(heap)
            # stale: the left symbol is gone or changed, or its right neighbour is another one now
            if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get((joined, symbols[k]))) is not None:
                    push(heap, (m[0], i, joined, symbols[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], joined))) is not None:
                push(heap, (m[0], h, symbols[h], joined, m[1]))
        return tuple(s for s in symbols if s >= 0)

    def plain(self, text: str) -> list[int]:
        cache, merge, ids = self.cache, self.merge, []
        get, extend = cache.get, ids.extend
        for m in self.pre_tokens.findall(text):
            found = get(m)
            if found is None:
                found = merge(m.encode())
                if len(m) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[m] = found
            extend(found)
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special_at is None or not self.special_at.search(text):
            return self.plain(text)
        ids, at = [], 0
        for m in self.special_at.finditer(text):
            ids += self.plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self.plain(text[at:])

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ids: array of token ids of the whole text."""

    @F.pandas_udf("array<int>")
    def run(texts):
        bpe = vocabulary(path)
        return texts.map(bpe.encode)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column text: the decoded token ids (null: the empty text)."""

    @F.pandas_udf("string")
    def run(values):
        bpe = vocabulary(path)
        return values.map(lambda x: bpe.decode(() if x is None else x))

    return df.withColumn(text, run(F.col(ids)))


def encode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids: encodes and decodes each whole text."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        names = [str(i) for i in range(len(bpe.strings))]
        sha = hashlib.sha256
        for b in batches:
            n, one, two, kept = [], [], [], []
            for x in b.column(1):
                ids = bpe.encode(x.as_py())
                n.append(len(ids))
                one.append(sha(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                two.append(sha(bpe.decode(ids).encode()).hexdigest())
                kept.append(np.array(ids, np.int32) if with_ids else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(kept, pa.list_(pa.int32()))], ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    out = out.withColumnRenamed("key", key)
    return out if with_ids else out.drop("ids")

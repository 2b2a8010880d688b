"""Hashes of k-mers: minimum shingle hash and bins as native expressions, lookup3 as a vectorised function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 16
#: Fixed value: the multiplier of Knuth's multiplicative hash.
KNUTH = 2654435761


def knuth_hash(x: Column) -> Column:
    """x * KNUTH modulo 2**32 of x in 0 .. 2**32 - 1; the product is taken in two halves, as 64 bits would overflow."""
    low = x.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(KNUTH)
    high = (F.shiftrightunsigned(x, 16) * F.lit(KNUTH)).bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def shingles(kmer: Column | str, k: int) -> Column:
    """The k - 15 numbers of 16 bases, two bits each, of a k-mer.

    Up to 31 bases become one number, of which 16 shingles are shifted out; longer k-mers are such pieces that overlap by 15 bases.
    """
    if k < SHINGLE:
        raise ValueError(f"k-mers need {SHINGLE} bases at least")
    digits = F.translate(F.col(kmer) if isinstance(kmer, str) else kmer, "ACGT", "0123")
    pieces = [(at, min(2 * SHINGLE - 1, k - at)) for at in range(0, k - SHINGLE + 1, SHINGLE)]
    numbers = F.array(*(F.struct(F.conv(F.substring(digits, at + 1, n), 4, 10).cast("long").alias("v"), F.lit(n - SHINGLE).alias("last")) for at, n in pieces))
    shifted = lambda p: F.transform(F.sequence(p["last"], F.lit(0)), lambda i: F.call_function("shiftright", p["v"], 2 * i).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.flatten(F.transform(numbers, shifted))


def min_hash(kmer: Column | str, k: int) -> Column:
    """The smallest hash of a k-mer's shingles: neighbouring k-mers mostly have the same."""
    return F.array_min(F.transform(shingles(kmer, k), knuth_hash))


def min_hash_words(word: np.ndarray, k: int) -> np.ndarray:
    """min_hash() of words of functions.packed of k bases, 32 at most."""
    if not SHINGLE <= k <= 2 * SHINGLE:
        raise ValueError(f"k-mers of a word with shingles have {SHINGLE} to {2 * SHINGLE} bases")
    half, out = np.uint64(0xFFFFFFFF), None
    for i in range(k - SHINGLE + 1):
        x = (word >> np.uint64(2 * i) & half) * np.uint64(KNUTH) & half
        out = x if out is None else np.minimum(out, x)
    return out.astype(np.int64)


def kmer_bin(h: Column, bins: int) -> Column:
    return F.pmod(h, F.lit(bins)).cast("int")


#: Rotations of the hash's mixing steps, in order.
MIX_ROTATIONS = (4, 6, 8, 16, 19, 4)
FINAL_ROTATIONS = (14, 11, 25, 16, 4, 14, 24)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def hashlittle2(keys: np.ndarray, pc: np.ndarray | int = 0, pb: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of each row of bytes (rows x length), all rows at once."""
    n, length = keys.shape
    with np.errstate(over="ignore"):
        start = np.uint32((0xDEADBEEF + length) & 0xFFFFFFFF) + np.broadcast_to(np.asarray(pc, np.uint32), n)
        s = [start.copy(), start.copy(), start + np.broadcast_to(np.asarray(pb, np.uint32), n)]
        if not length:
            return s[2], s[1]
        blocks = max(1, -(-length // 12))
        padded = np.zeros((n, 12 * blocks), np.uint8)
        padded[:, :length] = keys
        words = np.ascontiguousarray(padded).view("<u4").reshape(n, blocks, 3)
        for b in range(blocks):
            for i in range(3):
                s[i] = s[i] + words[:, b, i]
            if b < blocks - 1:
                # each step takes the third from the first, folds the third's rotation in and adds the second to the third
                for step, r in enumerate(MIX_ROTATIONS):
                    x, y, z = step % 3, (step + 1) % 3, (step + 2) % 3
                    s[x] = (s[x] - s[z]) ^ _rotated(s[z], r)
                    s[z] = s[z] + s[y]
        for step, r in enumerate(FINAL_ROTATIONS):
            x, y = (2, 0, 1)[step % 3], (1, 2, 0)[step % 3]
            s[x] = (s[x] ^ s[y]) - _rotated(s[y], r)
    return s[2], s[1]


def packed(kmers: list[str]) -> np.ndarray:
    """Two bits a base, base i in byte i // 4 from bit 2 * (i % 4) on; all k-mers of one length."""
    n, k = len(kmers), len(kmers[0])
    letters = np.frombuffer("".join(kmers).encode(), np.uint8).reshape(n, k)
    code = np.zeros(256, np.uint8)
    code[list(b"ACGT")] = range(4)
    padded = np.zeros((n, -(-k // 4) * 4), np.uint8)
    padded[:, :k] = code[letters]
    return np.bitwise_or.reduce(padded.reshape(n, -1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=2)


def unpacked(data: np.ndarray, k: int) -> list[str]:
    codes = (data[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(data), -1)[:, :k]
    return [bytes(row).decode() for row in np.frombuffer(b"ACGT", np.uint8)[codes]]


def packed_hex(kmer: Column | str, k: int) -> Column:
    """The bytes of packed() as hexadecimal text, in native expressions."""
    digits = F.rpad(F.translate(F.col(kmer) if isinstance(kmer, str) else kmer, "ACGT", "0123"), -(-k // 4) * 4, "0")
    return F.concat(*(F.lpad(F.conv(F.reverse(F.substring(digits, at + 1, 4)), 4, 16), 2, "0") for at in range(0, k, 4)))


def packed_words(word: np.ndarray, k: int) -> np.ndarray:
    """packed() of words of functions.packed of k bases, 32 at most."""
    for by, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        word = word >> np.uint64(by) & np.uint64(mask) | (word & np.uint64(mask)) << np.uint64(by)
    return (word >> np.uint64(64 - 2 * k)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-k // 4)]


def packed_hashes(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of packed k-mers: whole bytes by hashlittle2, the bases that are left one by one."""
    whole = k // 4
    c, b = hashlittle2(data[:, :whole], seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF)
    h = c.astype(np.uint64) + (b.astype(np.uint64) << np.uint64(32))
    with np.errstate(over="ignore"):
        for i in range(k % 4):
            h = h * np.uint64(33) + (data[:, whole] >> np.uint8(2 * i) & 3).astype(np.uint64)
    return h


def kmer_hashes(kmers: list[str], seed: int = 0) -> np.ndarray:
    """packed_hashes() of k-mers of one length."""
    return packed_hashes(packed(kmers), len(kmers[0]), seed)


def kmer_hash(kmer: Column | str, seed: int = 0) -> Column:
    """The 64-bit hash as a signed number."""

    @F.pandas_udf("long")
    def run(s):
        import pandas as pd

        out = pd.Series(0, index=s.index, dtype="int64")
        for _, part in s.groupby(s.str.len()):
            out[part.index] = kmer_hashes(part.tolist(), seed).view(np.int64)
        return out

    return run(F.col(kmer) if isinstance(kmer, str) else kmer)

"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line of a text is good or bad. Its evidence is its own shape (share of letters, symbols, capitals, digits, word lengths,
punctuation) and that of the lines before and after it; transitions tie neighbouring lines. The field is
fitted by gradient ascent on its likelihood with the labels of documents as labels of their lines. The forward-backward
marginals of the lines, weighted by length, add up to the share of good text, which a logistic curve
fitted on the same rows turns into the score. Labels, lang, source and doc_id are no inputs of a score.

It is fitted on at most SAMPLE labelled documents, one text of each, those with the smallest hashes of doc_id whose crc32 mod 5 is
not 0; of these it takes, in this order, what fits into SAMPLE_BYTES of text and SAMPLE_LINES lines. The parameters (a few hundred numbers) go to the tasks with
the function. Scoring is a map: no shuffle.

Defined cases: null and empty texts are one empty line; a line without a word has the shape of zeros; rows are scored one by
one, so repeated rows get repeated scores; null labels teach nothing; without labels of both kinds each
score is the share of label 1, or 0.5. Extra columns are ignored. Texts of any length are scored whole, a part of their lines at a time: what is held for a line are
its evidence and its length, beside the text itself and the different lines that it had so far.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import text_bytes

#: Labelled documents that the field is fitted on at most.
SAMPLE = 4000
#: Bytes of text that the field is fitted on at most: the sample meets on the driver. Scores take texts of any length.
SAMPLE_BYTES = 48 << 20
#: Lines that the field is fitted on at most: each has FEATURES numbers on the driver.
SAMPLE_LINES = 200_000
#: Lines, and about how many bytes of whole lines, that are looked at at once.
PART_LINES, PART_BYTES = 4096, 1 << 18
ROUNDS = 150
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.3

#: What each byte is: lower-case letter, capital, digit, one of the marks that separate sentences, symbol, byte of a longer character, blank.
KINDS = ("lower", "capital", "digit", "stop", "symbol", "high", "blank")


def _kinds() -> np.ndarray:
    out = np.full(256, KINDS.index("symbol"), np.uint8)
    for kind, chars in (("lower", range(97, 123)), ("capital", range(65, 91)), ("digit", range(48, 58)), ("stop", b".,;:'\"()-"), ("high", range(128, 256)), ("blank", b" \t\n\x0b\x0c\r")):
        out[list(chars)] = KINDS.index(kind)
    return out


KIND = _kinds()
#: Symbols with a share of their own.
OWN = np.frombuffer(b"|!#$%&*?<>{}=/_@", np.uint8)
#: Own statistics of a line; each is also taken of the lines before and after.
OWN_FEATURES = len(KINDS) + len(OWN) + 10
FEATURES = 3 * OWN_FEATURES + 3


def line_parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of whole lines."""
    at = 0
    while True:
        end = text.find(b"\n", at + PART_BYTES)
        part = text[at:] if end < 0 else text[at:end]
        if part.count(b"\n") >= PART_LINES:
            end = at + int(np.flatnonzero(np.frombuffer(part, np.uint8) == 10)[PART_LINES - 1])
            part = text[at:end]
        yield part
        if end < 0:
            return
        at = end + 1


def line_shapes(text: bytes, seen: set[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of each line of a text (lines x OWN_FEATURES), and the bytes of each line. seen: lines of the parts before, to which these are added."""
    data = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts
    n = len(ends)
    line = np.repeat(np.arange(n), size + 1)
    kind = KIND[data]
    share = np.bincount(line * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, -1).astype(np.float64)
    share[:, -1] -= 1  # the line end
    blank = kind == len(KINDS) - 1
    first = ~blank & np.r_[True, blank[:-1]]
    words = np.bincount(line[first], minlength=n)
    last = ~blank & np.r_[blank[1:], True]
    marked = np.bincount(line[last & (kind == KINDS.index("symbol"))], minlength=n)
    capital = np.bincount(line[first & (kind == KINDS.index("capital"))], minlength=n)
    spot = np.full(256, len(OWN), np.uint8)
    spot[OWN] = np.arange(len(OWN))
    hits = np.flatnonzero(spot[data] < len(OWN))
    own = np.bincount(line[hits] * len(OWN) + spot[data[hits]], minlength=n * len(OWN)).reshape(n, -1)
    filled = np.maximum(1, size - share[:, -1])[:, None]
    some = np.maximum(1, words)
    lone = np.bincount(line[first & last], minlength=n)
    rest = np.stack([np.log1p(words) / 5, np.minimum(3, filled[:, 0] / some / 5), marked / some, capital / some, lone / some, words == 0, share[:, KINDS.index("capital")] > share[:, KINDS.index("lower")]], axis=1)
    # words that repeat the one before, words that the line had before, and lines that the text had before
    again = np.zeros((n, 3))
    seen = set() if seen is None else seen
    for i, x in enumerate(text.split(b"\n")):
        if len(w := x.split()) > 1:
            again[i, 0] = sum(map(eq, w, w[1:])) / len(w)
            again[i, 1] = 1 - len(set(w)) / len(w)
        if w:
            again[i, 2] = x in seen
            seen.add(x)
    return np.concatenate([share / filled, np.minimum(2, own / some[:, None]), rest, again], axis=1), size


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """The statistics of each line, of the lines before and after it, whether those exist, and 1."""
    zero = np.zeros((1, x.shape[1]))
    n = len(x)
    edge = np.zeros((n, 3))
    edge[0, 0] = edge[-1, 1] = edge[:, 2] = 1
    return np.concatenate([x, np.concatenate([zero, x[:-1]]), np.concatenate([x[1:], zero]), edge], axis=1)


@dataclass
class Field:
    weights: np.ndarray  # FEATURES: evidence for "good"
    moves: np.ndarray  # 2 x 2: from, to
    slope: float = 1.0
    offset: float = 0.0


def marginals(evidence: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each move, by forward-backward in scaled probabilities."""
    n = len(evidence)
    e = np.clip(evidence, -30, 30)
    b = np.exp(e - np.maximum(e, 0)), np.exp(-np.maximum(e, 0))  # of good, of bad
    m = np.exp(moves)
    (m00, m01), (m10, m11) = m.tolist()
    good, bad = b[0].tolist(), b[1].tolist()
    forward, p, q = [], 1.0, 1.0
    for i in range(n):
        if i:
            p, q = p * m11 + q * m01, p * m10 + q * m00
        p, q = p * good[i], q * bad[i]
        s = p + q
        p, q = p / s, q / s
        forward.append((p, q))
    out, pairs = np.empty(n), np.zeros((2, 2))
    u, v = 1.0, 1.0
    for i in range(n - 1, -1, -1):
        p, q = forward[i]
        s = p * u + q * v
        out[i] = p * u / s
        if i:
            x, y = good[i] * u, bad[i] * v
            p, q = forward[i - 1]
            w = q * m00 * y, q * m01 * x, p * m10 * y, p * m11 * x
            s = sum(w)
            pairs += np.array(w).reshape(2, 2) / s
            u, v = m11 * x + m10 * y, m01 * x + m00 * y
            s = u + v
            u, v = u / s, v / s
    return out, pairs


def evidence(field: Field, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The evidence for "good" of each line, from its own statistics and those of the lines before and after it, and the bytes of each line."""
    own, before, after = field.weights[: 3 * OWN_FEATURES].reshape(3, OWN_FEATURES)
    first, last, always = field.weights[3 * OWN_FEATURES :]
    seen: set[bytes] = set()
    out, sizes, carried = [], [], first
    for part in line_parts(text):
        x, size = line_shapes(part, seen)
        e = x @ own + always
        e[0] += carried
        b, a = x @ before, x @ after
        e[1:] += b[:-1]
        e[:-1] += a[1:]
        if out:
            out[-1][-1] += a[0]
        carried = b[-1]
        out.append(e)
        sizes.append(size.astype(np.int32))
    out[-1][-1] += last
    return np.concatenate(out), np.concatenate(sizes)


def good_mean(e: np.ndarray, moves: np.ndarray, weight: np.ndarray) -> float:
    """The weighted mean of the marginals P(good), by forward-backward in parts: states are kept at the beginnings of parts only."""
    (m00, m01), (m10, m11) = np.exp(moves).tolist()
    starts = range(0, len(e), PART_LINES)

    def forward(at: int, p: float, q: float) -> tuple[list[float], list[float], list[float]]:
        """P(good) so far of the lines of a part, and what their evidence adds; p and q are those of the line before."""
        x = np.clip(e[at : at + PART_LINES], -30, 30)
        good, bad = np.exp(x - np.maximum(x, 0)).tolist(), np.exp(-np.maximum(x, 0)).tolist()
        out = []
        for i, (g, b) in enumerate(zip(good, bad, strict=True)):
            if at or i:
                p, q = p * m11 + q * m01, p * m10 + q * m00
            p, q = p * g, q * b
            p = p / (p + q)
            q = 1 - p
            out.append(p)
        return out, good, bad

    known = [(1.0, 1.0)]
    for at in starts:
        part = forward(at, *known[-1])
        known.append((part[0][-1], 1 - part[0][-1]))
    total, u, v = 0.0, 1.0, 1.0
    for n in range(len(starts) - 1, -1, -1):
        ps, good, bad = part if n == len(starts) - 1 else forward(starts[n], *known[n])
        ws = weight[starts[n] : starts[n] + PART_LINES].tolist()
        for p, g, b, w in zip(reversed(ps), reversed(good), reversed(bad), reversed(ws), strict=True):
            x, y = p * u, (1 - p) * v
            total += w * x / (x + y)
            x, y = g * u, b * v
            u, v = m11 * x + m10 * y, m01 * x + m00 * y
            s = u + v
            u, v = u / s, v / s
    return total / float(weight.sum())


def good_share(field: Field, text: bytes) -> float:
    """The length-weighted mean of the marginals, as a log-odds."""
    e, size = evidence(field, text)
    mean = float(np.clip(good_mean(e, field.moves, size + 1.0), 1e-6, 1 - 1e-6))
    return float(np.log(mean / (1 - mean)))


def score(field: Field, text: bytes) -> float:
    return float(1 / (1 + np.exp(-np.clip(field.slope * good_share(field, text) + field.offset, -40, 40))))


def fit(rows: list[tuple[int, bytes]]) -> Field:
    """The field for (label, text) rows. The order of rows does not matter beyond rounding."""
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    labels = np.array([y for y, _ in rows], float)
    if not len(rows) or labels.min() == labels.max():
        field.slope, field.offset = 0.0, float(np.log(labels.mean() / (1 - labels.mean()))) if len(rows) and 0 < labels.mean() < 1 else (30.0 * (2 * labels.mean() - 1) if len(rows) else 0.0)
        return field
    at = np.cumsum([0] + [t.count(b"\n") + 1 for _, t in rows])
    big, weight = np.empty((at[-1], FEATURES)), np.empty(at[-1])
    for i, (_, t) in enumerate(rows):
        x, s = line_shapes(t)
        big[at[i] : at[i + 1]] = with_neighbours(x)
        # a document counts once, whatever its number of lines, and a line by its length
        weight[at[i] : at[i + 1]] = (s + 1.0) / (s + 1.0).sum()
    y = np.repeat(labels, np.diff(at))
    moved = [0.0, 0.0]
    for (label, _), n in zip(rows, np.diff(at).tolist(), strict=True):
        moved[label] += (n - 1) / n
    # Adam on the likelihood of evidence; chains are walked for all documents at once
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    index = [at[order[: np.searchsorted(-length[order], -k, side="left")]] + k for k in range(length.max())]
    mean, square, step = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), 0
    for _ in range(ROUNDS):
        step += 1
        p, pairs = _all_marginals(np.clip(big @ field.weights, -30, 30), field.moves, index, length[order])
        g = np.r_[big.T @ (weight * (y - p)), (np.array([[moved[0], 0], [0, moved[1]]]) - pairs).ravel()] / len(rows)
        g -= DECAY * np.r_[field.weights, field.moves.ravel()]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        field.weights = field.weights + move[:-4]
        field.moves = np.clip(field.moves + move[-4:].reshape(2, 2), -2, 2)
    # the logistic curve over the shares of good text, by Newton's method with a small ridge
    z = np.array([good_share(field, t) for _, t in rows])
    a = np.array([1.0, 0.0])
    design = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -40, 40)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        a = a + np.linalg.solve(h, design.T @ (labels - p) - 1e-2 * (a - np.array([1.0, 0.0])))
    field.slope, field.offset = float(max(a[0], 1e-3)), float(a[1])
    return field


def _all_marginals(e: np.ndarray, moves: np.ndarray, index: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """marginals() for many documents at once: index[k] has the places of the k-th lines, longest document first."""
    m = np.exp(moves)
    b = np.stack([np.exp(-np.maximum(e, 0)), np.exp(e - np.maximum(e, 0))], axis=1)
    f = np.empty_like(b)
    for k, at in enumerate(index):
        now = b[at] * (f[index[k - 1][: len(at)]] @ m) if k else b[at].copy()
        f[at] = now / now.sum(axis=1, keepdims=True)
    out, pairs = np.empty(len(e)), np.zeros((2, 2))
    back = np.ones_like(b)
    each = 1.0 / length
    for k in range(len(index) - 1, -1, -1):
        at = index[k]
        both = f[at] * back[at]
        out[at] = both[:, 1] / both.sum(axis=1)
        if k:
            before = index[k - 1][: len(at)]
            ahead = b[at] * back[at]
            joint = f[before][:, :, None] * m[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True) * each[: len(at), None, None]).sum(axis=0)
            now = ahead @ m.T
            back[before] = now / now.sum(axis=1, keepdims=True)
    return out, pairs


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, most_lines: int = SAMPLE_LINES) -> list[tuple[int, bytes]]:
    """(quality, text) of at most `most` labelled documents, `most_bytes` of text and `most_lines` lines, none of them held out.

    Of a doc_id with several texts one is taken, that with the smallest hash. The labels' side of the joins is bounded by `most`.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select("doc_id", body.alias("text"), F.xxhash64(body).alias("digest"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("digest", F.octet_length("text").alias("size"), (F.size(F.split("text", "\n", -1))).alias("lines"))).alias("one"))
    picked, left, lines = [], most_bytes, most_lines
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["one"]["size"] <= left and r["one"]["lines"] <= lines:
            picked.append((r["doc_id"], r["quality"], r["one"]["digest"]))
            left, lines = left - r["one"]["size"], lines - r["one"]["lines"]
    if not picked:
        return []
    wanted = documents.sparkSession.createDataFrame(picked, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, quality int, digest long")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "digest"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return [(r["quality"], r["text"].encode()) for r in sorted(rows, key=lambda r: r["doc_id"])]


def scored(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of each row; a null key is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([score(field, t) for t in text_bytes(b.column(1))])
            held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["key", "held_out", "score", "predicted"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)

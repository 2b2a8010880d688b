"""Centroid clustering of vectors with Yinyang filters, in whole numbers.

Components become floor(SCALE * x). Each round assigns every vector to the nearest centroid, by squared Euclidean distance and then the
smaller number, and moves each centroid that has vectors to the floor of their mean; a last assignment follows.

Centroids are put into groups once. A vector keeps an upper bound of the distance to its centroid and, for each group, a lower bound of
the distances to the group's other centroids. After centroids moved, bounds are widened by how far. A vector whose upper bound lies below all
lower bounds stays (global filter); else its own distance is taken and only groups with a lower bound that is not above it (group filter) are scanned,
all their centroids exactly. Bounds are rounded outwards and compared strictly, so neither rounding nor ties change a result.

A round is one map over the vectors with their state, written to the shared folder; each task adds one row of sums for each centroid to what it
writes. The driver sees centroids and their sums only: numbers by K and DIMS, not by the data. No vector is shuffled.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out; repeated rows count as often as they occur; a
null key is kept but is no first centroid; rows of one key are ordered by their vector; with fewer vectors than K there are as many centroids as
vectors with a key; without any the result is empty. A component beyond LARGEST fails the query, as distances would not fit a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, written

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Centroids in a group, on average.
GROUP = 4
#: Of a component after scaling.
LARGEST = 1 << 27
#: Share by which bounds are rounded outwards: far more than the errors of a square root and some sums.
MARGIN = 1e-9


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """key and q, the vectors of dims finite components as whole numbers."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = df.select(F.col(key).alias("key"), x.alias("x")).where(F.size("x") == dims)
    # NaN is above all numbers
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    fits = F.forall("x", lambda v: F.abs(v * scale) < LARGEST)
    return rows.select("key", F.when(fits, F.transform("x", lambda v: F.floor(v * scale))).otherwise(F.raise_error(F.concat(F.lit("components are too large: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))).alias("q"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by rows of c) of whole numbers."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(c).max()))
    # products and sums of doubles are exact as long as they stay below 2**53
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


def below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


def grouped(c: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means over the centroids themselves."""
    n = max(1, -(-len(c) // size))
    mid = c[:n].astype(np.float64)
    of = np.zeros(len(c), np.int64)
    for _ in range(5):
        of = ((c[:, None, :] - mid[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(of):
            mid[g] = c[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


@dataclass
class State:
    """Of some vectors: the centroid, an upper bound of its distance, and for each group a lower bound of those of its other centroids."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_state(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> State:
    d = squared(x, c)
    own = d.argmin(axis=1)  # the first of equal ones
    rows = np.arange(len(x))
    upper = above(d[rows, own])
    rest = d.astype(np.float64)
    rest[rows, own] = np.inf
    lower = np.stack([below(rest[:, of == g].min(axis=1)) for g in range(of.max() + 1)], axis=1)
    return State(own, upper, lower)


def next_state(s: State, x: np.ndarray, c: np.ndarray, of: np.ndarray, moved: np.ndarray) -> tuple[State, int]:
    """The state after centroids moved by the squared distances `moved`, and the number of exact distances that were taken."""
    step = above(moved)
    cluster, upper, lower = s.cluster.copy(), s.upper + step[s.cluster], s.lower.copy()
    upper *= 1 + MARGIN
    for g in range(lower.shape[1]):
        lower[:, g] = (lower[:, g] - step[of == g].max()) * (1 - MARGIN)
    # below nothing: such a bound tells nothing, and widening it further must not raise it
    np.maximum(lower, 0, out=lower)
    open_ = np.flatnonzero(upper >= lower.min(axis=1))
    if not len(open_):
        return State(cluster, upper, lower), 0
    own = ((x[open_] - c[cluster[open_]]) ** 2).sum(axis=1)
    upper[open_] = above(own)
    taken = len(open_)
    still = upper[open_] >= lower[open_].min(axis=1)
    rows, own = open_[still], own[still]
    old, best, at = cluster[rows], own.copy(), cluster[rows].copy()
    tight = lower[rows]
    scanned = [np.flatnonzero(upper[rows] >= tight[:, g]) for g in range(lower.shape[1])]
    exact: list[tuple[np.ndarray, np.ndarray]] = []
    for g, some in enumerate(scanned):
        members = np.flatnonzero(of == g)
        d = squared(x[rows[some]], c[members])
        taken += d.size
        exact.append((members, d))
        if len(some):
            nearest = d.argmin(axis=1)
            distance, number = d[np.arange(len(some)), nearest], members[nearest]
            better = (distance < best[some]) | (distance == best[some]) & (number < at[some])
            best[some[better]], at[some[better]] = distance[better], number[better]
    for g, some in enumerate(scanned):
        members, d = exact[g]
        if len(some):
            rest = np.where(members[None, :] == at[some][:, None], np.inf, d)
            tight[some, g] = below(rest.min(axis=1))
    # a centroid that was left is one of the others of its group from now on
    left = np.flatnonzero(at != old)
    tight[left, of[old[left]]] = np.minimum(tight[left, of[old[left]]], below(own[left]))
    cluster[rows], upper[rows], lower[rows] = at, above(best), tight
    return State(cluster, upper, lower), taken


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _assigned(now: DataFrame, c: np.ndarray, of: np.ndarray, moved: np.ndarray | None, kind: str) -> DataFrame:
    """key, q, cluster, distance, upper, lower of each vector, and for each task and centroid a row of sums and n."""
    dims, groups = c.shape[1], int(of.max()) + 1
    numbers = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, key_type = np.zeros((len(c), dims), np.int64), np.zeros(len(c), np.int64), pa.null()
        for b in batches:
            key_type = b.column(0).type
            x = _vectors(b.column(1), dims)
            if moved is None:
                s = first_state(x, c, of)
            else:
                s, _ = next_state(State(b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), _vectors(b.column(4), groups)), x, c, of, moved)
            for i in np.unique(s.cluster):
                sums[i] += x[s.cluster == i].sum(axis=0)
            n += np.bincount(s.cluster, minlength=len(c))
            distance = ((x - c[s.cluster]) ** 2).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, groups * len(x) + 1, groups, dtype=np.int32)), pa.array(s.lower.ravel()))
            columns = b.column(0), b.column(1), pa.array(s.cluster.astype(np.int32)), pa.array(distance), pa.array(s.upper), lists, pa.nulls(len(x), numbers), pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), names)
        some = np.flatnonzero(n)
        nothing = lambda t: pa.nulls(len(some), t)
        columns = nothing(key_type), nothing(numbers), pa.array(some.astype(np.int32)), nothing(pa.int64()), nothing(pa.float64()), nothing(pa.list_(pa.float64())), pa.array(sums[some].tolist(), numbers), pa.array(n[some])
        if len(some):
            yield pa.RecordBatch.from_arrays(list(columns), names)

    names = ["key", "q", "cluster", "distance", "upper", "lower", "sums", "n"]
    rows = now.select("key", "q") if moved is None else now.where("sums is null").select("key", "q", "cluster", "upper", "lower")
    return rows.mapInArrow(run, f"key {kind}, q array<long>, cluster int, distance long, upper double, lower array<double>, sums array<long>, n long")


def _means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids with those that have vectors moved to the floor of the mean."""
    each = state.where("sums is not null").select("cluster", "n", F.posexplode("sums").alias("at", "v"))
    out = c.copy()
    for r in each.groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["at"]] = int(r["v"]) // r["n"]
    return out


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia and inertia (distance summed over the cluster and over all), centroid_sha256."""
    kind = df.schema[key].dataType.simpleString()
    vectors = written(quantised(df, key, vector, dims, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    c = np.array([r["q"] for r in vectors.where("key is not null").select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()], np.int64)
    if not len(c):
        nothing = vectors.where(F.lit(False)).select(F.col("key").alias(key), *(F.lit(None).cast(t).alias(x) for x, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
        return nothing
    of, moved, now = grouped(c), None, vectors
    for left in range(rounds, -1, -1):
        before, now = now, written(_assigned(now, c, of, moved, kind), "state")
        drop_written(before)
        if left:
            was, c = c, _means(now, c)
            moved = ((c - was) ** 2).sum(axis=1)
    found = now.where("sums is null")
    total = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return found.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        of_cluster([total.get(i, 0) for i in range(len(c))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )

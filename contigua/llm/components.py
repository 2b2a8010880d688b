"""Connected components of an edge table by alternating star contraction.

Each round is two groupings and joins over the edges that are left; the edges of a round are written to the
shared folder, so that a lost executor costs at most one round. No group is collected: the minimum of a
node's neighbours is an aggregate that is combined before the shuffle. At most FEW edges, counted, are finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import drop_written, written

#: Edges that one task takes at most, whatever the size of the input.
FEW = 50_000


def smallest(u: np.ndarray, v: np.ndarray) -> dict[int, int]:
    """The smallest node of the component of each node that edges touch."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(y, y)
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {x: root(x) for x in above}


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a task."""
    edges = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if edges:
        roots = {x: r for x, r in smallest(*(np.concatenate(c) for c in zip(*edges, strict=True))).items() if x != r}
        yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], ["node", "root"])


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v): hangs neighbours on the smallest one."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """For edges (a, b) of bigint nodes: rows (node, root) of every node that is not the smallest of its component.

    Repeated edges, loops and either direction are allowed; edges with a null end are no edges. No edges: no rows.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    told = None
    if now.count() <= few:
        out = written(now.coalesce(1).mapInArrow(_at_once, "node long, root long"), "roots")
        drop_written(now)
        return out
    while True:
        nxt = written(_starred(_starred(now, True), False), "edges")
        drop_written(now)
        now = nxt
        # the edges stand still once they are a star for each component: their number and sums no longer change
        seen = now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == told:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = seen

"""Connected components of links between long ids: forests in every task, then one task for what is left if that is bounded, else large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import remove, staged


#: Links (16 bytes each) that one task takes to its end.
ONE_TASK = 2_000_000


class Forest:
    """Union-find over indexes; the smaller index is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, node) with the same components as the given ones, one for each node but the roots."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(ids))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        forest.join(a, b)
    root = np.array([forest.find(i) for i in range(len(ids))], np.int64)
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[other]], ids[other]


def _thinned(batches, every: int = 500_000):
    """Each task keeps a spanning forest of what it has read, in bounded pieces."""
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def flush():
        u, v = spanning(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, us)) >= every:
            yield flush()
            us, vs = [], []
    if us:
        yield flush()


def _whole(batches):
    """node, root of all links in one task."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
    root, node = spanning(np.concatenate(us), np.concatenate(vs))
    own = np.unique(root)
    node, root = np.concatenate([node, own]), np.concatenate([root, own])
    for i in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000], pa.int64()), pa.array(root[i : i + 100_000], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of ``links`` (u, v); loops and repeated links are fine.

    Every task keeps a spanning forest of its links. If at most ONE_TASK links are left, one task ends the work. Beyond
    that they end as stars around the smallest node of each component: a round is two joins of the links with the
    smallest neighbour of each node, which is aggregated before it is shuffled; rounds grow with the logarithm of the
    longest path. The result is the same either way.
    """
    spark = links.sparkSession
    ordered = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = staged(links.where("u <> v").mapInArrow(_thinned, "u long, v long").select(*ordered), "links")
    if edges.count() <= ONE_TASK:
        out = staged(edges.repartition(1).mapInArrow(_whole, "node long, root long"), "components")
        remove(spark, edges.staged_at)
        return out
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = staged(small, "links")
        remove(spark, edges.staged_at)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


class Forest:
    """Union-find over arbitrary keys; the smaller key is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def thinned(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (u, v) without those that close a circle within a partition; the forest is emptied each `most` edges."""

    def run(batches):
        forest, n = Forest(), 0
        for b in batches:
            kept = [(u, v) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if forest.union(u, v)]
            n += len(kept)
            if n > most:
                forest, n = Forest(), 0
            a = np.array(kept, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round, saved. Large: each node links its larger neighbours to its smallest one. Small: the same for smaller ones.

    The least neighbours are written first: then the join has two plain shuffles, or a broadcast, and the edges of a hub are split over tasks.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    result = saved(out.filter("u <> v").distinct())
    discard(edges.sparkSession, least)
    return result


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs, any direction, loops and repeats allowed -> (node, root): root is the smallest node reachable.

    Nodes without an edge to another node don't appear. Ends when a double round changes nothing.
    """
    now = saved(thinned(edges.filter("u is not null and v is not null and u <> v")))
    seen = None
    for _ in range(rounds):
        wide = star(now, True)
        before, now = now, star(wide, False)
        discard(now.sparkSession, before, wide)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        seen = mark
    raise RuntimeError(f"components: no end after {rounds} rounds")

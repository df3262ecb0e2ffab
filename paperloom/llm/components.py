"""Connected components by alternating large-star and small-star steps, after a union-find inside each partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch


class Union:
    """Union-find over arbitrary hashable ids; the smallest id of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = (a, b) if a < b else (b, a)
        self.up[b] = a
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a graph replaced by (node, smallest node of its component)."""
    u = Union()
    for x, y in zip(a.tolist(), b.tolist()):
        u.join(x, y)
    nodes = list(u.up)
    return np.array(nodes, np.int64), np.array([u.find(x) for x in nodes], np.int64)


def _local(frames):
    for f in frames:
        hi, lo = forest(f["hi"].to_numpy(), f["lo"].to_numpy())
        yield pd.DataFrame({"hi": hi, "lo": lo})


def _ordered(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct()


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo")))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of edges(hi long, lo long) that is not itself the smallest of its component.

    Every step keeps at most as many edges as there were; hubs cost no group in memory, as stars are made with a
    partially aggregated minimum and a join that Spark may split. Steps are written to the shared folder.
    """
    e = scratch.write(_ordered(edges.mapInPandas(_local, "hi long, lo long")), f"{name}-0")
    k = 0
    while True:
        nxt = scratch.write(_ordered(_small(_ordered(_large(e)))), f"{name}-{k + 1}")
        many = nxt.select("hi").intersect(nxt.select("lo")).limit(1).count() + nxt.groupBy("hi").count().where("count > 1").limit(1).count()
        scratch.drop(f"{name}-{k}")
        e, k = nxt, k + 1
        if not many:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))

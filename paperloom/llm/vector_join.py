"""Embedding near-dedup by a subspace pigeonhole join, exact.

Unit vectors with cosine c or more are within the squared distance 2 - 2c. Vectors are rotated (so that no subspace
is special) and split into blocks of BLOCK_DIMS coordinates; of two vectors within the budget, some block's part is
within that block's share of it, in proportion to its dimensions. Each block is range-joined by itself: vectors go to
the leaves of a tree of splits, and to every other leaf whose bounding box their ball of the block's radius meets;
inside a pair of leaves block distances pick candidates, which are verified by the full cosine in double precision. A
pair counts in the first block that admits it, so links need no deduplication and are never emitted: tasks return
counts per vector and the edges of a forest.

Equal vectors are one node with a multiplicity from the start, whatever their ids. Leaves hold about LEAF vectors,
which bounds a task; larger leaves are dealt over parts by a hash. What comes to the driver and travels to the workers
is bounded: 16 sampled vectors and one bounding box a leaf and block, and there are MOST_LEAVES leaves at most. In high
dimensions few balls miss a leaf, so the work grows nearly with the square of the number of distinct vectors; the
pairs that leave the block test are what the method saves.

Rows are vectors: rows that share a vec_id but hold different vectors link each for itself. Vectors that are null,
empty, zero, or hold null or non-finite components link with nothing (component_id is their own vec_id); vectors of
different lengths link with nothing of another length. Rows with a null vec_id take part; component_id is the smallest
id of the component that is not null (null if none is), and such a row is kept only then. Tables may be empty; extra
columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch
from paperloom.llm.components import components, forest

COSINE, BLOCK_DIMS, LEAF, SAMPLE = 0.9, 16, 24_000, 4_000
MOST_LEAVES = 4_096  # of a block
SLACK32, TILE, GATHER = 2e-3, 512, 50_000


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[slice]:
    n = max(1, round(d / BLOCK_DIMS))
    edge = [round(k * d / n) for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:])]


def _units(raw: list[bytes], d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Median splits of a sample along the widest coordinate; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.split: list[tuple] = []  # (dimension, value, left, right); a leaf is a negative number
        self.n = 0
        self.top = self._grow(sample, max(1, leaves))

    def _grow(self, x: np.ndarray, leaves: int):
        if leaves <= 1 or len(x) < 2 or (spread := x.max(axis=0) - x.min(axis=0)).max() <= 0:
            self.n += 1
            return -self.n
        dim = int(spread.argmax())
        value = float(np.median(x[:, dim]))
        left = x[:, dim] < value
        if not left.any():
            value, left = float(np.nextafter(value, np.inf)), x[:, dim] <= value
            if left.all():
                self.n += 1
                return -self.n
        k = len(self.split)
        self.split.append(None)
        a, b = self._grow(x[left], leaves // 2), self._grow(x[~left], leaves - leaves // 2)
        self.split[k] = (dim, value, a, b)
        return k

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 0)
        todo = [(self.top, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k < 0:
                out[rows] = -k - 1
            else:
                dim, value, a, b = self.split[k]
                left = x[rows, dim] < value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def _join(frame: pd.DataFrame, d: int, cosine: float) -> pd.DataFrame:
    """Links between side 0 and side 1 (or inside side 2) of one task of one block."""
    block = int(frame["block"].iloc[0])
    frame = frame.sort_values("node")
    own = bool((frame["side"] == 2).any())
    sides = [frame] if own else [frame[frame["side"] == s] for s in (0, 1)]
    if not all(map(len, sides)):
        return pd.DataFrame({"hi": [], "lo": [], "links": []}, dtype=np.int64)
    r, cuts, budget = rotation(d), blocks_of(d), 2 - 2 * cosine
    data = [(_units(list(s["vector"]), d), s["node"].to_numpy(), s["many"].to_numpy()) for s in sides]
    turned = [x @ r for x, _, _ in data]
    (x, nx, mx), (y, ny, my) = data[0], data[-1]
    tx, ty = turned[0], turned[-1]
    share = [budget * (c.stop - c.start) / d + 1e-9 for c in cuts]
    fx, fy = tx[:, cuts[block]].astype(np.float32), ty[:, cuts[block]].astype(np.float32)
    sx, sy = (fx * fx).sum(axis=1), (fy * fy).sum(axis=1)
    links_x, links_y, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for at in range(0, len(x), TILE):
        to = min(at + TILE, len(x))
        base = at if own else 0
        close = fx[at:to] @ fy[base:].T
        close *= -2
        close += sx[at:to, None]
        close += sy[None, base:]
        flat = np.flatnonzero(close.ravel() <= share[block] + SLACK32)
        width = len(y) - base
        for k in range(0, len(flat), GATHER):
            i, j = flat[k : k + GATHER] // width + at, flat[k : k + GATHER] % width + base
            if own:
                i, j = i[j > i], j[j > i]
            ok = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            i, j = i[ok], j[ok]
            for b in range(block + 1):  # the first block that admits the pair counts it
                diff = tx[i, cuts[b]] - ty[j, cuts[b]]
                admits = (diff * diff).sum(axis=1) <= share[b]
                keep = admits if b == block else ~admits
                i, j = i[keep], j[keep]
            np.add.at(links_x, i, my[j])
            np.add.at(links_y, j, mx[i])
            edges.append(forest(np.maximum(nx[i], ny[j]), np.minimum(nx[i], ny[j])))
    if own:
        links_x += links_y
    out = [pd.DataFrame({"hi": nx, "lo": nx, "links": links_x})] + ([] if own else [pd.DataFrame({"hi": ny, "lo": ny, "links": links_y})])
    out = [o[o["links"] > 0] for o in out]
    if edges:
        hi, lo = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        out.append(pd.DataFrame({"hi": hi, "lo": lo, "links": 0}))
        out[-1] = out[-1][out[-1]["hi"] != out[-1]["lo"]]
    return pd.concat(out)


def _pack(column: str) -> F.Column:
    return F.transform(column, lambda v: v.cast("double"))


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = COSINE, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of rows(vec_id, embedding)."""
    with Scratch(spark) as s:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), _pack("embedding").alias("v"))
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)) & F.exists("v", lambda c: c != 0)
        usable = F.coalesce((F.size("v") > 0) & finite, F.lit(False))
        rows = s.write(rows.withColumn("usable", usable).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v")), "rows")
        same = rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("v").alias("v"))
        nodes = s.write(same.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "nodes")  # numbered once, as written

        found = None
        for size in sorted(r["d"] for r in nodes.select("d").distinct().collect()):
            part = _links(nodes.where(F.col("d") == size).select("node", "many", "h1", "v"), size, cosine, leaf)
            found = part if found is None else found.union(part)
        if found is None:
            found = spark.createDataFrame([], "hi long, lo long, links long")
        found = s.write(found, "found")
        comp = components(s, found.where("hi <> lo").select("hi", "lo"), "comp")
        links = found.groupBy(F.col("hi").alias("node")).agg(F.sum("links").alias("links"))
        known = nodes.select("h1", "h2", "node", "least", "many").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
        known = known.join(links, "node", "left").join(ids, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable"))
        out = rows.select("vec_id", "h1", "h2", "usable").join(known, ["h1", "h2", "usable"], "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
        return s.result(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _links(vectors: DataFrame, d: int, cosine: float, leaf: int) -> DataFrame:
    """Edges (hi, lo) with 0 links, and the number of links of each node as (node, node, links)."""
    n = vectors.count()
    r, cuts, budget = rotation(d), blocks_of(d), 2 - 2 * cosine
    leaves = min(MOST_LEAVES, -(-n // leaf))
    sample = vectors.where(F.pmod("h1", F.lit(max(1, n // max(SAMPLE, 16 * leaves)))) == 0).select("v").collect()  # only places the splits
    turned = _units([np.array(x["v"], np.float64).tobytes() for x in sample], d) @ r if sample else np.zeros((0, d))
    trees = [Tree(turned[:, c], leaves) for c in cuts]

    def placed(frames):
        for f in frames:
            raw = [np.asarray(v, np.float64).tobytes() for v in f["v"]]
            t = _units(raw, d) @ r
            yield f, raw, t, [tree.leaf(t[:, c]) for tree, c in zip(trees, cuts)]

    def measure(frames):
        for _, _, t, own in placed(frames):
            for b, c in enumerate(cuts):
                for k in np.unique(own[b]).tolist():
                    x = t[own[b] == k][:, c]
                    yield pd.DataFrame({"block": [b], "leaf": [k], "n": [len(x)], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})

    wide = max(c.stop - c.start for c in cuts)
    bounds = [f(F.get(name, F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(wide)]
    boxes = vectors.select("v").mapInPandas(measure, "block int, leaf int, n long, low array<double>, high array<double>").groupBy("block", "leaf").agg(F.sum("n").alias("n"), *bounds)
    sizes: list[dict] = [{} for _ in cuts]
    for x in boxes.collect():  # a row per leaf and block
        side = lambda name, m=cuts[x["block"]]: np.array([x[f"{name}{i}"] for i in range(m.stop - m.start)])
        sizes[x["block"]][x["leaf"]] = (-(-x["n"] // (2 * leaf)), side("low"), side("high"))
    first = []  # number of the first part of each leaf
    for own in sizes:
        at, number = 0, {}
        for k in sorted(own):
            number[k], at = at, at + own[k][0]
        first.append(number)
    span = 1 << 24

    def deal(frames):
        for f, raw, t, own in placed(frames):
            node, many, vector = f["node"].to_numpy(), f["many"].to_numpy(), np.array(raw, dtype=object)
            deal_by = (node * 0x9E3779B1 >> 16) & 0x7FFFFFFF
            for b, c in enumerate(cuts):
                x, share = t[:, c], budget * (c.stop - c.start) / d + 1e-9
                parts = np.array([sizes[b][k][0] for k in own[b].tolist()], np.int64)
                unit = np.array([first[b][k] for k in own[b].tolist()], np.int64) + deal_by % parts
                for k, (many_parts, low, high) in sizes[b].items():
                    gap = np.maximum(0, np.maximum(low - x, x - high))
                    near = np.flatnonzero((gap * gap).sum(axis=1) <= share)
                    for other in range(first[b][k], first[b][k] + many_parts) if len(near) else ():
                        u = unit[near]
                        side = np.where(u == other, 2, (u > other).astype(np.int64))
                        task = (b * span + np.minimum(u, other)) * span + np.maximum(u, other)
                        yield pd.DataFrame({"task": task, "side": side, "block": b, "node": node[near], "many": many[near], "vector": vector[near]})

    dealt = vectors.select("node", "many", "v").mapInPandas(deal, "task long, side int, block int, node long, many long, vector binary")
    return dealt.groupBy("task").applyInPandas(lambda f: _join(f, d, cosine), "hi long, lo long, links long")

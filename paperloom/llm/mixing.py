"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, mapped through the cumulative shares of the sources, deal out slots; the slots of a source are
ranked, and slot r takes block r mod (number of blocks) of the source's documents, which were shuffled by a seeded
hash and cut into blocks of equal numbers of words. So every source's words follow its target to within a few blocks
at every point of the schedule, and repeats come in whole rounds.

Sizes, totals and shuffled positions cover all rows. No window is over a whole source: positions and ranks are sums
over stretches of hashes or slots plus sums inside one. There is a slot for every WORDS_EACH words, but no more than
SLOTS and no fewer than LEAST_SLOTS. Only one row per source comes to the driver and goes to the tasks; there may be
MOST_SOURCES sources, and more raise an error.

Null texts and texts without words have size 0 and are taken 0 times; the null source comes last in the order of
weights. Rows with null or repeated ids are rows of their own. An empty table gives an empty table; extra columns are
not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, at_most

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SLOTS, LEAST_SLOTS, WORDS_EACH, LEAST_BLOCKS, STRETCH = 1 << 20, 1 << 14, 64, 256, 1 << 15
MOST_SOURCES = 50_000
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights=WEIGHTS, most: int = MOST) -> dict:
    """Target words per source: shares of the total by weight, none above most times its source's size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _div(a: str, b: str) -> str:
    return f"CAST(floor(({a}) / ({b})) AS BIGINT)"


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, most: int = MOST, slots: int = SLOTS, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of docs(doc_id, text, source)."""
    with Scratch(spark) as s:
        return _mix(s, docs, weights, most, slots, seed)


def _mix(s: Scratch, docs: DataFrame, weights, most: int, slots: int, seed: int) -> DataFrame:
    spark = s.spark
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce("text", F.lit("")).alias("text"))
    sized = sized.select("doc_id", "source", "size", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("h"))
    sized = s.write(sized.withColumn("stretch", F.shiftright("h", 64 - 10)), "sized")
    per = {r["source"]: (r["words"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()}
    if len(per) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    words = {k: v[0] for k, v in per.items()}
    goal = targets(words, weights, most)
    total = sum(words.values())
    order = sorted((k for k in words if k is not None)) + [None] * (None in words)
    slots = max(1, min(slots, max(LEAST_SLOTS, total // WORDS_EACH)))
    each = max(1, -(-total // slots))
    blocks = {k: max(-(-words[k] // each), min(words[k], LEAST_BLOCKS)) for k in order}
    uses = [goal[k] * blocks[k] / words[k] if words[k] else 0.0 for k in order]
    n = round(sum(uses))
    edges = np.cumsum(uses) / max(sum(uses), 1e-300)
    # as Arrow: a list would be turned into rows by Python workers, which then stay beside those of the next operator
    columns = {"sid": (range(len(order)), pa.int32()), "source": (order, pa.string()), "source_size": ([words[k] for k in order], pa.int64()), "blocks": ([blocks[k] for k in order], pa.int64()), "target": ([goal[k] for k in order], pa.float64())}
    source = spark.createDataFrame(pa.table({c: pa.array(x, t) for c, (x, t) in columns.items()}))

    point = (F.col("id") + 0.5) * GOLDEN % 1.0
    sid = F.least(at_most([float(e) for e in edges], point, "double"), F.lit(max(0, len(order) - 1))).cast("int")
    dealt = spark.range(n).select(sid.alias("sid"), "id", F.floor(F.col("id") / STRETCH).alias("part"))
    parts = dealt.groupBy("sid", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("sid").orderBy("part")) - F.col("count")).drop("count")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("sid", "part").orderBy("id")) - 1).join(parts, ["sid", "part"])
    block = ranked.join(F.broadcast(source.select("sid", "blocks")), "sid").withColumn("r", F.col("r") + F.col("before")).where(F.col("r") < most * F.col("blocks"))
    used = block.groupBy("sid", (F.col("r") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))

    docs_ = sized.join(F.broadcast(source), sized["source"].eqNullSafe(source["source"])).drop(source["source"])
    sums = docs_.groupBy("sid", "stretch").agg(F.sum("size").alias("own")).withColumn("base", F.sum("own").over(Window.partitionBy("sid").orderBy("stretch")) - F.col("own")).drop("own")
    inside = F.sum("size").over(Window.partitionBy("sid", "stretch").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = docs_.withColumn("a", inside).join(sums, ["sid", "stretch"]).withColumn("a", F.col("a") + F.col("base"))
    placed = s.write(placed.select("doc_id", "source", "size", "source_size", "target", "sid", "blocks", "a"), "placed")
    wide = "CAST({} AS DECIMAL(38,0))"
    at = lambda x: _div(f"{wide.format(x)} * blocks + blocks - 1", "source_size")  # noqa: E731  the block that holds word x
    cut = placed.where("size > 0").select("sid", "a", "size", "blocks", "source_size", F.explode(F.expr(f"sequence({at('a')}, {at('a + size - 1')})")).alias("block"))
    cut = cut.withColumn("lo", F.expr(_div(f"{wide.format('block')} * source_size", "blocks"))).withColumn("hi", F.expr(_div(f"{wide.format('block + 1')} * source_size", "blocks")))
    cut = cut.join(used, ["sid", "block"]).groupBy("sid", "a").agg(F.sum((F.least(F.col("a") + F.col("size"), "hi") - F.greatest("a", "lo")) * F.col("uses")).alias("taken"))
    got = placed.where("size > 0").join(cut, ["sid", "a"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return s.result(got.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def resample(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as the mix takes it (to a whole number, by a hash).

    The schedule takes taken words of a document of size words, so floor(taken / size + u) copies with u in [0, 1)
    from a hash of doc_id have the right number on average. Documents without words are in no block and go.
    """
    taken = mix(spark, docs, **parameters).where("size > 0").groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    u = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = taken.select(F.col("doc_id").alias("mixed_id"), F.floor(F.col("taken") / F.col("size") + u).cast("int").alias("copies")).where("copies > 0")
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))  # one column, whose names clash with nothing
    joined = rows.join(copies, rows["doc_id"].eqNullSafe(copies["mixed_id"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")

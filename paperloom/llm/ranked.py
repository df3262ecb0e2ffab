"""Ranked lexical search over a clustered index: recursive graph bisection orders documents, shards are visited by bound.

*Order.* Documents and terms are the two sides of a graph. Recursive bisection splits a sample of documents in halves
again and again and swaps documents between the halves as long as that lowers the sum of log gaps of their postings. The
sample (`SAMPLE_DOCS`, of each at most `SAMPLE_TERMS` terms; both documented bounds) only places the borders: every
document of the corpus then walks down the tree of halves, each time into the half where its postings cost less. A leaf
that holds more postings than a shard may (a hot cluster, many copies) is dealt over several shards.

*Index.* A row for each term of each shard: the documents' places in the shard, their impacts (what a term adds to a
score, but for its weight) and the largest impact; beside them, for each shard, the doc_ids by place. Texts are read once
and never shuffled; what is shuffled, once, are terms with their counts.

*Search.* An item's bound in a shard is the sum over its terms of weight times largest impact. Shards are visited in
waves (8, 32, 128, ... by falling bound); an item leaves out the shards whose bound is below the score of its k-th best
document so far. Bounds that are equal to it are visited, as a smaller doc_id may win the tie, so results are exact.
Places are in order of doc_id within a shard and are mapped back to doc_id there.

Null texts, or texts without a term, are in no result, and items without terms (or whose terms no document has) have
none. Rows that share a doc_id are documents of their own, null doc_ids come last among equal scores; repeated rows of
one item count once. Empty tables give empty results; extra columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import U64, Scratch, lean, ranges, splitmix

SAMPLE_DOCS, SAMPLE_TERMS, VOCABULARY = 4096, 256, 8192
LEAST_LEAF, MOST_LEAVES, ROUNDS = 16, 256, 10
SHARD_POSTINGS = 1 << 20
FIRST_WAVE, WAVE_GROWTH = 8, 4
ITEM_BLOCK = 1024
#: Term bytes: 0-9, A-Z (lower-cased), a-z and all of code points beyond ASCII; the rest separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


# ---------------------------------------------------------------- the order
class Router(NamedTuple):
    """weights[level][node, term]: how much cheaper a term is in the first half of a node."""

    terms: list[bytes]
    weights: list[np.ndarray]

    def leaves(self) -> int:
        return 1 << len(self.weights)

    def route(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        """The leaf of each document; doc, term: its terms of the vocabulary."""
        node = np.zeros(n_docs, np.int64)
        for w in self.weights:
            gain = np.bincount(doc, weights=w[node[doc], term], minlength=n_docs)
            node = 2 * node + (gain <= 0)
        return node


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits of the gaps of a term with so many postings among n documents."""
    return degree * np.log2(max(n, 1) / (degree + 1))


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, depth: int) -> list[np.ndarray]:
    """Halves documents depth times; (doc, term): the edges, by doc. Returns the weights of the router."""
    node, weights = np.zeros(n_docs, np.int64), []
    for level in range(depth):
        w = np.zeros((1 << level, n_terms), np.float32)
        side = np.zeros(n_docs, np.int64)
        edge_order = np.argsort(node[doc], kind="stable")
        edge_node = node[doc][edge_order]
        docs_by_node = np.argsort(node, kind="stable")
        for k in range(1 << level):
            members = docs_by_node[np.searchsorted(node[docs_by_node], k) : np.searchsorted(node[docs_by_node], k, side="right")]
            edges = edge_order[np.searchsorted(edge_node, k) : np.searchsorted(edge_node, k, side="right")]
            d, (names, t) = doc[edges], np.unique(term[edges], return_inverse=True)
            side[members] = np.arange(len(members)) % 2
            n = [int((side[members] == s).sum()) for s in (0, 1)]
            for _ in range(ROUNDS):
                degree = [np.bincount(t[side[d] == s], minlength=len(names)).astype(float) for s in (0, 1)]
                gain = np.zeros(n_docs)
                for s in (0, 1):  # what leaving side s saves
                    here, there = degree[s], degree[1 - s]
                    saved = _cost(here, n[s]) + _cost(there, n[1 - s]) - _cost(np.maximum(here - 1, 0), n[s]) - _cost(there + 1, n[1 - s])
                    own = side[d] == s
                    gain += np.bincount(d[own], weights=saved[t[own]], minlength=n_docs)
                ranked = [sorted(members[side[members] == s].tolist(), key=lambda x: (-gain[x], x)) for s in (0, 1)]
                swaps = [(a, b) for a, b in zip(*ranked) if gain[a] + gain[b] > 0]
                for a, b in swaps:
                    side[a], side[b] = 1, 0
                if not swaps:
                    break
            degree = [np.bincount(t[side[d] == s], minlength=len(names)).astype(float) for s in (0, 1)]
            joins = [_cost(degree[s] + 1, n[s] + 1) - _cost(degree[s], n[s]) for s in (0, 1)]
            w[k, names] = joins[1] - joins[0]
        weights.append(w)
        node = 2 * node + side
    return weights


def fit_router(sample: list, leaves: int) -> Router:
    """sample: the terms of each sampled document. Terms of one document alone, or of most, tell nothing."""
    seen = Counter(t for ts in sample for t in ts)
    terms = sorted((t for t, k in seen.items() if 2 <= k <= max(2, len(sample) // 2)), key=lambda t: (-seen[t], t))[:VOCABULARY]
    depth = max(0, int(np.log2(max(1, min(leaves, len(sample) // LEAST_LEAF)))))
    at = {t: i for i, t in enumerate(terms)}
    edges = [(i, at[t]) for i, ts in enumerate(sample) for t in ts if t in at]
    doc, term = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
    return Router(terms, bisect(doc, term, len(sample), max(1, len(terms)), depth))


# ---------------------------------------------------------------- the index
class Index(NamedTuple):
    """postings(shard, term, places, impacts, top, doc_ids): doc_ids only where term is null, all else only elsewhere."""

    postings: DataFrame
    documents: int
    shards: int


def _forward(batches):
    """Terms and counts of each document, with a salt that deals rows out evenly, repeated ones too."""
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts = [Counter(terms_of(t)) if t else {} for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            offsets = np.cumsum([0, *map(len, counts)]).astype(np.int32)
            salt = splitmix(np.arange(k, k + len(counts), dtype=U64) | U64(task) << U64(40)) >> U64(32)
            k += len(counts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(part.schema.get_field_index("doc_id")), "salt": pa.array(salt.astype(np.int64)), "n": pa.array([sum(c.values()) for c in counts], pa.int64()),
                "terms": pa.ListArray.from_arrays(pa.array(offsets), pa.array([t for c in counts for t in c], pa.binary())),
                "counts": pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for c in counts for x in c.values()], pa.int32())),
            })


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements."""
    lens = np.asarray(pc.list_value_length(column), np.int64)
    return np.repeat(np.arange(len(lens)), lens), column.flatten()


def _routed(router: Router, vocabulary: pa.Array):
    def route(batches):
        for batch in batches:
            doc, terms = _flat(batch.column(batch.schema.get_field_index("terms")))
            at = np.asarray(pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1), np.int64)
            leaf = router.route(doc[at >= 0], at[at >= 0], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    return route


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, but for its weight; n: the documents' numbers of terms."""
    lengths, at = np.unique(n, return_inverse=True)
    m = np.array([100 - 90 + 90 * int(x) * documents // total for x in lengths], np.int64)[at]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _inverted(documents: int, total: int):
    def invert(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("salt", "ascending")]).combine_chunks()  # null ids last
        doc, terms = _flat(table.column("terms").combine_chunks())
        tf = np.asarray(_flat(table.column("counts").combine_chunks())[1], np.int64)
        coded = terms.dictionary_encode()
        code = np.asarray(coded.indices, np.int64)
        order = np.argsort(code, kind="stable")  # places stay in order within a term
        impact = impacts(tf, np.asarray(table.column("n"), np.int64)[doc], documents, total)[order]
        a, b = ranges(code[order])
        offsets = pa.array(np.concatenate(([0], b)).astype(np.int32))
        shard, ids = table.column("shard")[0], pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        n = len(a)
        posted = pa.table({
            "shard": pa.array([shard.as_py()] * n, pa.int64()), "term": coded.dictionary.take(pa.array(code[order][a])), "places": pa.ListArray.from_arrays(offsets, pa.array(doc[order].astype(np.int32))),
            "impacts": pa.ListArray.from_arrays(offsets, pa.array(impact.astype(np.int32))), "top": pa.array(np.maximum.reduceat(impact, a) if n else np.zeros(0, np.int64), pa.int64()), "doc_ids": pa.nulls(n, pa.list_(pa.int64())),
        }).sort_by("term")
        whole = pa.table({"shard": pa.array([shard.as_py()], pa.int64()), "doc_ids": ids})
        return pa.concat_tables([posted, whole.select(["shard"]).append_column("term", pa.nulls(1, pa.binary())).append_column("places", pa.nulls(1, pa.list_(pa.int32()))).append_column("impacts", pa.nulls(1, pa.list_(pa.int32()))).append_column("top", pa.nulls(1, pa.int64())).append_column("doc_ids", ids)])

    return invert


POSTINGS = "shard long, term binary, places array<int>, impacts array<int>, top long, doc_ids array<long>"


def build_index(scratch: Scratch, docs: DataFrame, shard_postings: int = SHARD_POSTINGS, key: str = "doc_id", text: str = "text") -> Index:
    """The clustered index of docs, written to the scratch folder."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    forward = scratch.write(rows.mapInArrow(lean("op11")(_forward), "doc_id long, salt long, n long, terms array<binary>, counts array<int>"), "forward").where("n > 0")
    sums = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("total"), F.sum(F.size("terms")).alias("postings")).first()
    if not sums["docs"]:
        scratch.drop("forward")
        return Index(scratch.spark.createDataFrame([], POSTINGS), 0, 0)
    few = F.transform(F.slice(F.array_sort(F.transform("terms", lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), 1, SAMPLE_TERMS), lambda x: x["t"])
    share = min(1.0, 2 * SAMPLE_DOCS / sums["docs"])  # about twice as many rows as are taken are ordered
    sample = forward.where(F.col("salt") < int(share * (1 << 32))).orderBy("salt", "doc_id").limit(SAMPLE_DOCS).select(few.alias("t"))
    leaves = min(MOST_LEAVES, sums["postings"] // shard_postings)
    router = fit_router([list(map(bytes, r["t"])) for r in sample.collect()], leaves)
    routed = forward.mapInArrow(lean("op11")(_routed(router, pa.array(router.terms, pa.binary()))), "doc_id long, salt long, n long, terms array<binary>, counts array<int>, leaf long")
    sizes = {r["leaf"]: r["k"] for r in routed.groupBy("leaf").agg(F.sum(F.size("terms")).alias("k")).collect()}  # MOST_LEAVES rows
    parts = [max(1, -(-sizes.get(leaf, 0) // shard_postings)) for leaf in range(router.leaves())]
    first = np.cumsum([0, *parts]).tolist()
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("leaf").cast("int"))
    sharded = routed.select((of(first[:-1]) + F.pmod("salt", of(parts))).alias("shard"), "doc_id", "salt", "n", "terms", "counts")
    inverted = sharded.repartition(max(first[-1], int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))), "shard").groupBy("shard").applyInArrow(_inverted(sums["docs"], sums["total"]), POSTINGS)
    postings = scratch.write(inverted, "postings")
    scratch.drop("forward")
    return Index(postings, sums["docs"], first[-1])


# ---------------------------------------------------------------- the search
def _item_terms(batches):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [sorted(set(terms_of(t))) if t else [] for t in texts]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(offsets), pa.array([t for ts in found for t in ts], pa.binary()))
        yield pa.RecordBatch.from_pydict({"item": batch.column(batch.schema.get_field_index("item")), "terms": terms})


def _scored(k: int):
    def score(asked: pa.Table, postings: pa.Table) -> pa.Table:
        """The k best documents of a shard for each item that visits it."""
        term, places, impact = (postings.column(c).to_pylist() if c == "term" else postings.column(c).combine_chunks() for c in ("term", "places", "impacts"))
        at = {t: i for i, t in enumerate(term)}
        if None not in at:  # no document at all
            return pa.table({"item": pa.array([], pa.string()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids = np.array(postings.column("doc_ids")[at[None]].as_py(), object)
        items, wanted, weight = asked.column("item").to_pylist(), asked.column("term").to_pylist(), np.asarray(asked.column("w"), np.int64)
        by_item: dict[str, list[int]] = {}
        for i, name in enumerate(items):
            by_item.setdefault(name, []).append(i)
        known: dict[int, tuple] = {}
        out: list[tuple] = []
        for name, asks in by_item.items():
            total = np.zeros(len(ids), np.int64)
            for i in asks:
                p = at.get(wanted[i])
                if p is not None:
                    if p not in known:
                        known[p] = np.asarray(places[p].values), np.asarray(impact[p].values, np.int64)
                    total[known[p][0]] += weight[i] * known[p][1]
            best = np.flatnonzero(total > 0)
            if len(best) > k:
                best = best[total[best] >= np.partition(total[best], len(best) - k)[len(best) - k]]
            best = best[np.argsort(-total[best], kind="stable")][:k]  # equal scores stay in order of place, which is of doc_id
            out += [(name, d, s) for d, s in zip(ids[best].tolist(), total[best].tolist())]
        name, doc, total = zip(*out) if out else ((), (), ())
        return pa.table({"item": pa.array(name, pa.string()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(total, pa.int64())})

    return score


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(scratch: Scratch, index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item: (item_id, rank, doc_id, score), written to the scratch folder."""
    spark = scratch.spark
    named = F.sha2(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256)
    asked = items.select(F.col(key).alias("item_id"), F.col(text).alias("text"), named.alias("item")).dropDuplicates(["item"])
    terms = asked.select("item", "text").mapInArrow(lean("op11")(_item_terms), "item string, terms array<binary>").select("item", F.explode("terms").alias("term"))
    terms = scratch.write(terms, "terms")
    wanted = terms.select("term").distinct()
    needed = scratch.write(index.postings.join(wanted, "term", "left_semi").select(*index.postings.columns).unionByName(index.postings.where("term IS NULL")), "needed")
    n = index.documents
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    df = needed.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weighted = scratch.write(terms.join(df.select("term", weight), "term").where("w > 0"), "weighted")
    bounds = weighted.join(needed.where("term IS NOT NULL").select("shard", "term", "top"), "term").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    visit = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    visits = scratch.write(bounds.where("bound > 0").withColumn("visit", visit), "visits")
    blocks = max(1, -(-weighted.select("item").distinct().count() // ITEM_BLOCK))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    best = spark.createDataFrame([], "item string, doc_id long, score long, rank int")
    done, upto, wave = 0, FIRST_WAVE, 0
    while done < index.shards:
        worst = best.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        now = visits.join(worst, "item", "left").where((F.col("visit") > done) & (F.col("visit") <= upto) & (F.col("least").isNull() | (F.col("bound") >= F.col("least"))))
        now = scratch.write(now.select("item", "shard", block), f"now{wave}")
        if now.isEmpty():  # later shards have lower bounds still
            break
        ask = now.join(weighted, "item")
        there = needed.join(now.select("shard", F.col("block").alias("part")).distinct(), "shard")
        found = ask.groupBy("shard", "block").cogroup(there.groupBy("shard", "part")).applyInArrow(_scored(k), "item string, doc_id long, score long")
        found = _best(best.drop("rank").unionByName(found), k)
        best = scratch.write(found, f"best{wave}")
        if wave:
            scratch.drop(f"best{wave - 1}")
        done, upto, wave = upto, upto * WAVE_GROWTH, wave + 1
    return best.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Index and search in one go; the result lies in the scratch folder until the application ends."""
    with Scratch(spark) as scratch:
        return scratch.result(search(scratch, build_index(scratch, docs, shard_postings), items, k))

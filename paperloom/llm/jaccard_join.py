"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard), exact.

Two documents link when 100 * |A & B| >= 75 * |A | B|, i.e. when their distance is at most 1/4.

*Regions.* Pivots split the space into Voronoi regions. Between unrelated documents the distance is 1, so documents
as first pivots would leave every document on the border of every region; the first pivots are the singletons {s} of
the shingles instead. A set of n shingles has the distance 1 - 1/n to the pivots it contains and 1 to all others;
ties go to the rarer shingle, then to the smaller hash. The triangle inequality bounds how far from its first pivot a
document can still have a partner at distance 1/4: a partner lacks at most n - ceil(3n/4) of its shingles, so the
window holds its first n - ceil(3n/4) + 1 pivots, and two linked documents share a pivot in both windows. Pivots that
one document alone has are dropped at once, so that most documents have no region left.

*Recursion.* Documents that share regions are joined by documents as pivots: distances to a few far-apart ones, home
regions by the nearest, replication to every pivot within 2 * 1/4 of the home distance, until a region is small or no
longer shrinks; there each pair that is not connected yet and that no triangle inequality rules out is counted.
Regions over REGION_SHINGLES are split over tasks with some common pivots; components that stay apart then meet in
pairs of parts, so that neither one task nor all pairs of a group of copies are ever needed.

Equal sets are one node from the start, whatever the ids of their rows. Result: per row its set size and the smallest
doc_id reachable by links. Null or wordless texts have the empty set and link with nothing. Rows are documents: rows
that share a doc_id but differ in their texts link each for itself, and rows with a null doc_id take part like others;
component_id is the smallest doc_id of the component that is not null (null if none is). An empty table gives an empty
table; extra columns are ignored by the join.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import MESSAGE, U64, Distinct, Roller, Scratch, Texts, attach, blocks_of, bucket_key, exchange_counts, lean, lean_group, message_frame, partitions_for, ranges, splitmix, unpack
from paperloom.llm.components import Union, components, forest

WORDS = 5
PERCENT = 75
REGION_SHINGLES = 250_000
SALTS = 32
SHORT_WORD = 32  # bytes
PIECE = 2_000  # members of a hot pivot's piece
COMMON_PIVOTS = 12
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- sets
def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word. A polynomial mod 2^64 is the same for a long Thue-Morse word and its complement, whatever
    its base and byte table (their difference is divisible by ever higher powers of two), so it serves short words only."""
    out = Roller(data, 7).of(starts, ends)
    long = np.flatnonzero(ends - starts > SHORT_WORD)
    if len(long):
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist()))
        out[long] = np.frombuffer(digests, "<u8")
    return out


def shingle_sets(t: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, in one array, and how many each text has."""
    data = LOWER[t.bytes]
    n_docs = len(t.lens)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[t.starts] = True
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.concatenate((space[1:], [True])) if len(data) else space
    ends = np.flatnonzero(~space & (after | np.concatenate((edge[1:-1], [True])) if len(data) else space)) + 1
    word = word_hashes(data, starts, ends)
    doc = np.searchsorted(t.starts + t.lens, starts, side="right")
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n_words) - n_words
    n_sh = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    own = np.repeat(np.arange(n_docs), n_sh)
    at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    h = np.zeros(len(own), U64)
    for k in range(words):
        inside = k < n_words[own]
        w = np.where(inside, word[np.minimum(at + k, max(len(word) - 1, 0))], U64(0)) if len(word) else h
        h = splitmix(h + w * inside.astype(U64) + U64(k + 1))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    keep = np.concatenate(([True], (own[1:] != own[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return h[keep], np.bincount(own[keep], minlength=n_docs)


class _Describe:
    """Per document of a block: doc_id, size and two order-free hashes of its set."""

    type = pa.struct([("i", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    ddl = "struct<i:int,doc_id:bigint,n:bigint,h1:bigint,h2:bigint>"

    def __init__(self, words: int):
        self.words = words

    def __call__(self, table: pa.Table):
        h, n = shingle_sets(Texts(table), self.words)
        at = np.concatenate(([0], np.cumsum(n)))
        sums = [np.concatenate((np.zeros(1, U64), np.cumsum(splitmix(h + U64(k)), dtype=U64))) for k in (1, 2)]
        a, b = (splitmix(s[at[1:]] - s[at[:-1]] + n.astype(U64)).view(np.int64) for s in sums)
        ids = table.column("doc_id").to_pylist()
        return [{"i": i, "doc_id": d, "n": int(x), "h1": int(p), "h2": int(q)} for i, (d, x, p, q) in enumerate(zip(ids, n, a, b))]


class _Sets:
    """The sets of the chosen documents of a block."""

    def __init__(self, blob: bytes, chosen, words: int):
        h, n = shingle_sets(Texts(unpack(blob)), words)
        start = np.cumsum(n) - n
        chosen = sorted(chosen, key=lambda c: c["i"])
        self.index = np.array([c["i"] for c in chosen], np.int64)
        self.chosen = chosen
        self.n = n[self.index]
        own = np.repeat(np.arange(len(self.index)), self.n)
        self.own = own
        self.h = h[np.repeat(start[self.index], self.n) + np.arange(len(own)) - np.repeat(np.cumsum(self.n) - self.n, self.n)]


def _ask_counts(n_buckets: int, words: int):
    def ask(frames):
        for f in frames:
            for block, blob, chosen in zip(f["block"], f["part"], f["chosen"]):
                if chosen is not None and len(chosen):
                    yield message_frame(list(Distinct(bucket_key(_Sets(blob, chosen, words).h, n_buckets)).messages(block)))

    return ask


def window_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _windows(n_buckets: int, words: int, percent: int):
    """(bucket, shingle, node, n, hot) of the shared pivots in the window of each document.

    A pivot that many sets hold is hot: its members are dealt over pieces, each in a bucket of its own.
    """

    def make(frames):
        for f in frames:
            for blob, chosen, replies in zip(f["part"], f["chosen"], f["replies"]):
                if replies is None:
                    continue
                s = _Sets(blob, chosen, words)
                d = Distinct(bucket_key(s.h, n_buckets))
                code = d.answers(replies, n_buckets)[d.inverse]
                order = np.lexsort((s.h, code, s.own))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(s.n) - s.n, s.n)
                own, code = s.own[order], code[order]
                keep = (rank < window_size(s.n, percent)[own]) & (code > 0)
                node = np.array([c["node"] for c in s.chosen], np.int64)
                shingle, node = s.h[order][keep], node[own[keep]]
                pieces = np.ceil(2.0 ** ((code[keep].astype(float) - 1) / 4) / PIECE).astype(np.int64)  # a code is 1 + 4 * log2(times)
                piece = (splitmix(node.view(U64)) % pieces.astype(U64)).astype(U64)
                bucket = ((shingle + splitmix(piece + U64(1)) * (pieces > 1).astype(U64)) % U64(n_buckets)).astype(np.int32)
                yield pd.DataFrame({"bucket": bucket, "shingle": shingle.view(np.int64), "node": node, "n": s.n[own[keep]], "hot": pieces > 1})

    return make


def _share_pivots(percent: int):
    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        """Neighbours by size in each pivot's region, as far as sizes allow a link: a forest that spans them (first is
        null), and for each run of neighbours of a hot pivot its sizes and a member."""
        frame = frame.sort_values(["shingle", "n", "node"])
        sh, n, node, hot = (frame[c].to_numpy() for c in ("shingle", "n", "node", "hot"))
        near = (sh[1:] == sh[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
        hi, lo = forest(node[1:][near], node[:-1][near])
        out = pd.DataFrame({"hi": hi, "lo": lo, "shingle": 0, "first": pd.array([pd.NA] * len(hi), "Int64"), "last": pd.array([pd.NA] * len(hi), "Int64")})
        if not hot.any():
            return out
        a = np.flatnonzero(np.concatenate(([True], ~near)))
        b = np.append(a[1:], len(n)) - 1
        a, b = a[hot[a]], b[hot[a]]
        return pd.concat([out, pd.DataFrame({"hi": node[a], "lo": node[a], "shingle": sh[a], "first": pd.array(n[a], "Int64"), "last": pd.array(n[b], "Int64")})])

    return edges


def _join_runs(percent: int):
    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        """The runs of all pieces of one hot pivot: those whose sizes overlap or are near belong together."""
        frame = frame.sort_values(["first", "last", "hi"])
        first, top, node = frame["first"].to_numpy(np.int64), np.maximum.accumulate(frame["last"].to_numpy(np.int64)), frame["hi"].to_numpy(np.int64)
        near = top[:-1] * 100 >= first[1:] * percent
        return pd.DataFrame({"hi": node[1:][near], "lo": node[:-1][near]})

    return edges


def _ship(words: int):
    def ship(frames):
        for f in frames:
            for blob, chosen in zip(f["part"], f["chosen"]):
                if chosen is None or not len(chosen):
                    continue
                s = _Sets(blob, chosen, words)
                at = np.concatenate(([0], np.cumsum(s.n)))
                rows = [(t, c["region"], c["node"], c.get("comp", -1), s.h[at[k] : at[k + 1]].tobytes()) for k, c in enumerate(s.chosen) for t in c["tasks"]]
                yield pd.DataFrame(rows, columns=["task", "region", "node", "comp", "shingles"])

    return ship


# ---------------------------------------------------------------- exact join inside a region
class MetricJoin:
    """Connects the linked sets of one region (recursive Voronoi regions, see the module's docstring)."""

    SMALL = 48

    def __init__(self, sets: list[np.ndarray], comp: list | None = None, percent: int = PERCENT):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1) if sets else np.zeros(0, np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.percent, self.slack = percent, 1 - percent / 100 + 1e-9
        self.root = np.arange(len(sets))
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, np.uint8)
        if comp is not None:
            first: dict = {}
            for i, c in enumerate(comp):
                self.unite(first.setdefault(c, i), np.array([i]))
        self.links = 0

    def unite(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[a]))
        self.root[np.isin(self.root, roots)] = roots[0]

    def common(self, p: int, ids: np.ndarray) -> np.ndarray:
        own = self.flat[self.at[p] : self.at[p + 1]]
        self.mark[own] = 1
        n = self.n[ids]
        start = np.cumsum(n) - n
        where = np.repeat(self.at[ids] - start, n) + np.arange(int(n.sum()))
        got = np.add.reduceat(self.mark[self.flat[where]], start, dtype=np.int64) if len(where) else np.zeros(len(ids), np.int64)
        self.mark[own] = 0
        return got

    def visit(self, p: int, ids: np.ndarray) -> np.ndarray:
        """Links p with those of ids that are near; their distances to p."""
        both = self.common(p, ids)
        union = self.n[ids] + self.n[p] - both
        linked = ids[100 * both >= self.percent * union]
        self.links += len(linked)
        if (self.root[linked] != self.root[p]).any():
            self.unite(p, linked)
        return 1 - both / union

    def solve(self, ids: np.ndarray, depth: int = 0) -> None:
        """ids: all with sets of one word or more."""
        if len(ids) < 2 or (self.root[ids] == self.root[ids[0]]).all():
            return
        if len(ids) <= self.SMALL:
            return self.scan(ids, [])
        seen, pivots, far = [], [], np.full(len(ids), np.inf)
        for _ in range(8):
            p = int(np.argmax(far)) if pivots else int(np.argmin(np.abs(self.n[ids] - np.median(self.n[ids]))))
            if pivots and far[p] <= self.slack:
                break
            d = self.visit(int(ids[p]), ids)
            pivots.append(p)
            seen.append(d)
            far = np.minimum(far, d)
        d = np.stack(seen)
        home = d.min(axis=0)
        regions = [np.flatnonzero(row <= home + 2 * self.slack) for row in d]
        if depth < 8 and max(map(len, regions)) < 0.8 * len(ids):
            for r in regions:
                self.solve(ids[r], depth + 1)
        else:
            self.scan(ids, seen)

    def scan(self, ids: np.ndarray, seen: list[np.ndarray]) -> None:
        """Each of ids against the later ones that are in another component and within every pivot's window."""
        for k in range(len(ids) - 1):
            later = np.arange(k + 1, len(ids))
            later = later[self.root[ids[later]] != self.root[ids[k]]]
            a, b = self.n[ids[k]], self.n[ids[later]]
            later = later[100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)]
            for d in seen:
                later = later[np.abs(d[later] - d[k]) <= self.slack]
            if len(later):
                self.visit(int(ids[k]), ids[later])


def _join_task(percent: int):
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        hi, lo = [], []
        frame = frame.sort_values(["region", "node"]).drop_duplicates(["region", "node"])
        for a, b in zip(*ranges(frame["region"].to_numpy())):
            part = frame.iloc[a:b]
            node = part["node"].to_numpy()
            comp = part["comp"].to_numpy()
            m = MetricJoin([np.frombuffer(x, U64) for x in part["shingles"]], None if (comp < 0).all() else [(0, int(c)) if c >= 0 else (1, i) for i, c in enumerate(comp)], percent)
            m.solve(np.arange(len(node)))
            away = m.root != np.arange(len(node))
            hi.append(node[away])
            lo.append(node[m.root[away]])
        return pd.DataFrame({"hi": np.concatenate(hi) if hi else np.zeros(0, np.int64), "lo": np.concatenate(lo) if lo else np.zeros(0, np.int64)})

    return join


# ---------------------------------------------------------------- the operator
def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text)."""
    with Scratch(spark) as s:
        rows, nodes, _ = _components(s, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, percent)
        ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
        known = nodes.select("h1", "h2", "root").join(ids, "root").select("h1", "h2", "component_id")
        out = rows.join(known, ["h1", "h2"], "left")
        return s.result(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def near_unique(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component: that of the smallest doc_id (nulls last; rows of one id by
    their sets). Rows without words are in no component and stay."""
    with Scratch(spark) as s:
        rows, nodes, blocks = _components(s, docs.withColumn("doc_id", F.col("doc_id").cast("long")), words, percent)
        best = nodes.groupBy("root").agg(F.min("best").alias("best")).select("best.block", "best.i")
        kept = best.unionByName(rows.where("n = 0").select("block", "i")).groupBy("block").agg(F.collect_list("i").alias("chosen"))

        def take(batches):
            for batch in batches:
                for blob, chosen in zip(batch.column(batch.schema.get_field_index("part")).to_pylist(), batch.column(batch.schema.get_field_index("chosen")).to_pylist()):
                    if chosen:
                        yield from unpack(blob).take(pa.array(sorted(chosen))).to_batches(max_chunksize=2000)

        schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "doc_id" else f.dataType) for f in docs.schema.fields])
        return s.result(attach(blocks.select("block", "part"), kept).select("part", "chosen").mapInArrow(lean("op6")(take), schema).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema.fields]))


def _components(s: Scratch, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (block, i, doc_id, n, h1, h2), nodes (h1, h2, least, best, root), and the blocks."""
    spark = s.spark
    blocks = blocks_of(s, docs, describe=_Describe(words), describe_ddl=_Describe.ddl)
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    b = partitions_for(spark, n_bytes)
    rows = s.write(blocks.select("block", F.inline("docs")), "rows")
    # one node per set, numbered once, as written; best is the row that stands for it
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2", "block", "i")
    sets = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min(best).alias("best"), F.first("n").alias("n"))
    sets = s.write(sets.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "least", "best", "n", "best.block", "best.i"), "sets")

    chosen = s.write(sets.groupBy("block").agg(F.collect_list(F.struct("i", "node")).alias("chosen")), "chosen")
    asked = attach(blocks.select("block", "part"), chosen)
    counts = s.write(exchange_counts(asked.mapInPandas(lean("op6")(_ask_counts(b, words)), MESSAGE)), "counts")
    shared = attach(asked, counts).mapInPandas(lean("op6")(_windows(b, words, percent)), "bucket int, shingle long, node long, n long, hot boolean")
    found = s.write(shared.groupBy("bucket").applyInPandas(lean_group(_share_pivots(percent)), "hi long, lo long, shingle long, first long, last long"), "found")
    # written, so that no task needs a Python worker for the runs and one for the components at once
    across = s.write(found.where("first is not null").groupBy("shingle").applyInPandas(_join_runs(percent), "hi long, lo long"), "across")
    regions = components(s, found.where("first is null").select("hi", "lo").unionByName(across), "regions")
    s.drop("counts", "chosen", "found", "across")
    member = regions.select(F.col("node"), F.col("root").alias("region")).union(regions.select(F.col("root").alias("node"), F.col("root").alias("region")).distinct())
    member = member.join(sets.select("node", "n", "block", "i"), "node")

    # small regions share tasks; large ones are split, with common pivots in every part
    size = member.groupBy("region").agg(F.sum("n").alias("total"))
    member = member.join(size, "region").withColumn("parts", F.ceil(F.col("total") / REGION_SHINGLES).cast("long"))
    tasks = partitions_for(spark, n_bytes, BLOCK_SHIP)
    deal = F.xxhash64("node")
    one = F.concat(F.lit("s"), F.pmod(F.xxhash64("region"), F.lit(tasks)))
    pivot = F.pmod(deal, F.greatest(F.floor(F.col("total") / F.lit(COMMON_PIVOTS) / F.greatest(F.col("n"), F.lit(1))), F.lit(1))) == 0
    many = F.when(pivot, F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.concat_ws("#", F.col("region"), k))).otherwise(F.array(F.concat_ws("#", F.col("region"), F.pmod(F.shiftright(deal, 20), F.col("parts")))))
    member = s.write(member.withColumn("tasks", F.when(F.col("parts") == 1, F.array(one)).otherwise(many)), "member")
    links = s.write(_join(blocks, member.withColumn("comp", F.lit(-1).cast("long")), words, percent), "links-1")
    comp = components(s, links, "comp-1")

    split = member.where("parts > 1")
    if split.limit(1).count():
        links = s.write(links.union(_join(blocks, _pairs(split, comp), words, percent)), "links-2")
        comp = components(s, links, "comp-2")
    nodes = sets.select("h1", "h2", "node", "least", "best").join(comp, "node", "left").select("h1", "h2", "least", "best", F.coalesce("root", "node").alias("root"))
    return rows, nodes, blocks


BLOCK_SHIP = 8 << 20


def _join(blocks: DataFrame, member: DataFrame, words: int, percent: int) -> DataFrame:
    chosen = member.groupBy("block").agg(F.collect_list(F.struct("i", "node", "region", "comp", "tasks")).alias("chosen"))
    shipped = attach(blocks.select("block", "part"), chosen).mapInPandas(lean("op6")(_ship(words)), "task string, region long, node long, comp long, shingles binary")
    return shipped.groupBy("task").applyInPandas(lean_group(_join_task(percent)), "hi long, lo long")


def _pairs(split: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of split regions with the pairs of parts in which components that are still apart meet.

    A large component fills parts of its own, which need not meet each other; the rest of a region is dealt to mixed
    parts. comp is the component so far, as sets in it need not be compared.
    """
    half = REGION_SHINGLES // 2
    m = split.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "tasks", "parts")
    sizes = m.groupBy("region", "comp").agg(F.sum("n").alias("own"))
    rest = sizes.groupBy("region").agg(F.sum(F.when(F.col("own") < half, F.col("own")).otherwise(0)).alias("mixed"), F.count("*").alias("comps")).where("comps > 1")
    # the few rows of sizes meet a hot region or component in SALTS places
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = m.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int"))
    m = m.join(salted(rest), ["region", "salt"]).join(salted(sizes.where(F.col("own") >= half)), ["region", "comp", "salt"], "left").drop("salt").withColumn("own", F.coalesce("own", F.lit(0)))
    pure = F.col("own") >= half
    k = F.when(pure, F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / half))).otherwise(F.pmod(F.xxhash64("comp"), F.greatest(F.ceil(F.col("mixed") / half), F.lit(1))))
    m = m.withColumn("part", F.concat_ws("/", F.when(pure, F.col("comp").cast("string")).otherwise(F.lit("mix")), k))
    parts = m.groupBy("region", "part").agg(F.max(F.when(pure, F.col("comp"))).alias("whole"))
    a, b = parts.toDF("region", "a", "wa"), parts.toDF("region", "b", "wb")
    meet = a.join(b, "region").where("a <= b and (wa is null or wb is null or wa <> wb)").withColumn("task", F.concat_ws("#", "region", "a", "b"))
    both = meet.select("region", F.col("a").alias("part"), "task").union(meet.where("a <> b").select("region", F.col("b").alias("part"), "task"))
    return m.join(both.groupBy("region", "part").agg(F.collect_list("task").alias("tasks")), ["region", "part"])

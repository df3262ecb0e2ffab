"""A trigram index for substring search: texts in order of their prior score, postings by trigram.

`texts` holds the rows in blocks of falling prior (a folder each, so a block is read alone) with their places in the
block. `postings` holds the rows (bucket, gram, block, chunk, places), a folder for each bucket of trigrams, sorted by
trigram, so that a query reads the few row groups that hold its own; a chunk is 512 places, and a posting names places in
it by two bytes each. A gram is three code points in one long. `priors` (block, place, id, prior) is what a ranking has to
know of rows that no posting names. Trigrams are those of the lower-cased columns, joined by spaces.

A search intersects the rarest trigrams of each word, which bounds the score of each row from above. The rows of the
highest bounds are verified first; then those, and only those, whose bound reaches the last result's score (equal ones
too, as ties go by id), so results are those of a scan. Nothing but the results comes to the driver.
Words of two characters have no trigram: they count as possible everywhere, which only loosens the bound.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.cluster import shared_dir, ship_code
from paperloom.functions.text import lexical_score

BLOCK_ROWS = 50_000
BUCKETS = 64
RAREST = 3
MOST_NAMED = 10_000
CHUNK = 512  # places whose trigrams are sorted together


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as one long of three code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def bucket_of(gram, buckets: int):
    return (gram * 0x9E3779B1 >> 13) % buckets


class Spec(NamedTuple):
    id: str
    columns: tuple[str, ...]
    buckets: int


def _joined(columns: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def _posted(buckets: int):
    def post(batches):
        for batch in (b.slice(k, CHUNK) for b in batches for k in range(0, b.num_rows, CHUNK)):
            block, place = (np.asarray(batch.column(c), np.int64) for c in ("block", "place"))
            chunk = block << 32 | place // CHUNK
            grams = [grams_of(t) if t else np.zeros(0, np.int64) for t in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(place)), [len(g) for g in grams])
            gram = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            order = np.lexsort((place[row], gram, chunk[row]))
            row, gram = row[order], gram[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (chunk[row][1:] != chunk[row][:-1])
            at = np.flatnonzero(new)
            offsets = pa.array(np.append(at, len(gram)).astype(np.int32))
            with np.errstate(over="ignore"):
                bucket = bucket_of(gram[at], buckets).astype(np.int32)
            places = pa.ListArray.from_arrays(offsets, pa.array((place[row] % CHUNK).astype(np.int16)))
            first = row[at]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "gram": pa.array(gram[at]), "block": pa.array(block[first].astype(np.int32)), "chunk": pa.array((place[first] // CHUNK).astype(np.int32)), "places": places})

    return post


class TrigramIndex:
    """An index in a folder that all executors share; open it by its path and the columns it was built of."""

    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str], id_: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), Spec(id_, tuple(columns), buckets)

    def _read(self, name: str) -> DataFrame:
        texts = "".join(f"`{c}` string, " for c in self.spec.columns)
        schema = {"texts": f"`{self.spec.id}` long, {texts}prior double, place int, block int", "priors": "block int, place int, id long, prior double", "postings": "gram long, block int, chunk int, places array<short>, bucket int"}
        return self.spark.read.schema(schema[name]).parquet(f"{self.root}/{name}")

    @classmethod
    def build(cls, spark: SparkSession, root: str, rows: DataFrame, columns: Sequence[str], prior: Column, id_: str = "id", block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS) -> TrigramIndex:
        """Texts are shuffled once, into blocks; postings once, into buckets. Ids are whole numbers and not null."""
        ship_code(spark)
        out = cls(spark, root, columns, id_, buckets)
        ranked = rows.select(F.col(id_).cast("long").alias(id_), *[F.col(c).cast("string").alias(c) for c in columns], prior.cast("double").alias("prior"))
        blocks = max(1, -(-ranked.count() // block_rows))
        placed = ranked.repartitionByRange(blocks, F.desc("prior"), F.col(id_)).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int")).withColumn("block", F.spark_partition_id())
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("block").parquet(f"{out.root}/texts")
        texts = out._read("texts")
        texts.select("block", "place", F.col(id_).alias("id"), "prior").write.mode("overwrite").parquet(f"{out.root}/priors")
        posted = texts.select("block", "place", _joined(columns).alias("text")).mapInArrow(_posted(buckets), "bucket int, gram long, block int, chunk int, places array<short>")
        posted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "block", "chunk").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{out.root}/postings")
        return out

    def _postings(self, grams: list[int]) -> DataFrame:
        """Postings of these trigrams: their buckets' folders and, in them, the row groups that may hold them."""
        with np.errstate(over="ignore"):
            buckets = sorted({int(b) for b in bucket_of(np.array(grams, np.int64), self.spec.buckets)})
        return self._read("postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def _possible(self, words: Sequence[str]) -> DataFrame | None:
        """(block, place, words): how many of the words (with repeats) a row may contain; None if no word has a trigram."""
        grams = {w: grams_of(w).tolist() for w in set(words) if len(w) > 2}
        every = sorted({g for gs in grams.values() for g in gs})
        if not every:
            return None
        found = self._postings(every)
        often = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).collect()}  # of a query's trigrams
        asked = [(g, w, words.count(w), min(len(gs), RAREST)) for w, gs in grams.items() if all(g in often for g in gs) for g in sorted(gs, key=lambda g: (often[g], g))[:RAREST]]
        need = self.spark.createDataFrame(asked, "gram long, word string, times int, need int")  # RAREST rows a word
        rows = found.join(F.broadcast(need), "gram").select("word", "times", "need", "block", "chunk", F.explode("places").alias("place")).withColumn("place", F.col("chunk") * CHUNK + F.col("place"))
        hit = rows.groupBy("block", "place", "word").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("times").alias("times")).where("n >= need")
        return hit.groupBy("block", "place").agg(F.sum("times").alias("words"))

    def like(self, query: str) -> DataFrame:
        """Rows of which any column contains the query, case-insensitively; % and _ are wildcards, as in LIKE."""
        i, columns = self.spec.id, self.spec.columns
        runs = [r for r in re.split("[%_]", query.lower()) if len(r) > 2]
        possible, texts = self._possible(runs), self._read("texts")
        if possible is not None:
            rows = self._read("priors").join(possible.where(F.col("words") == len(runs)), ["block", "place"], "left_semi")
            texts = self._blocks_of(rows).join(rows.select(F.col("id").alias(i)), i, "left_semi")  # verified first: the filter below is pushed under the join
        verified = F.lit(False)
        for c in columns:
            verified = verified | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
        return texts.where(verified).select(i, *columns)

    def _blocks_of(self, rows: DataFrame) -> DataFrame:
        """The texts of the blocks of rows(block): only their folders are read, unless they are too many to name."""
        blocks = [r["block"] for r in rows.select("block").distinct().limit(MOST_NAMED + 1).collect()]
        texts = self._read("texts")
        return texts.where(F.col("block").isin(sorted(blocks))) if len(blocks) <= MOST_NAMED else texts

    def ranked(self, query: str, saved: DataFrame, limit: int = 100, of_words: float = 0.8, of_prior: float = 0.2) -> DataFrame:
        """(id, is_saved, score) of the best rows with a score above 0: saved(id) first, then by score and id. The score is
        of_words times the share of the query's words that the text contains, and of_prior times the prior."""
        i = self.spec.id
        words = [w for w in query.lower().split() if len(w) > 1]
        n, short = max(1, len(words)), sum(len(w) == 2 for w in words)
        possible = self._possible(words)
        bound = lambda k: F.round(of_words * (k / n) + of_prior * F.col("prior"), 6)
        rows = self._read("priors").join(saved.select(F.col(i).alias("id"), F.lit(True).alias("is_saved")).distinct(), "id", "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))
        rows = rows.join(possible, ["block", "place"], "left") if possible is not None else rows.withColumn("words", F.lit(None).cast("long"))
        rows = rows.withColumn("k", F.coalesce("words", F.lit(0)) + short).withColumn("bound", bound(F.col("k"))).where("bound > 0")
        asked = f"{shared_dir(self.spark)}/asked"  # read by each step below; the postings are looked through once
        rows.select("id", "block", "is_saved", "k", "bound").write.parquet(asked)
        rows = self.spark.read.schema("id long, block int, is_saved boolean, k long, bound double").parquet(asked)
        share = lexical_score(F.concat_ws(" ", *self.spec.columns), F.lit(query))

        def best(of: DataFrame, few: bool) -> DataFrame:
            """Rows without a possible word have their bound as score; of the others the texts are read: a few rows are
            sent to the texts, many meet the scores of the texts, so that no text is shuffled."""
            score = F.round(of_words * share + of_prior * F.col("prior"), 6)
            asked = of.where("k > 0")
            texts, ids = self._blocks_of(asked), asked.select(F.col("id").alias(i))
            texts = texts.join(F.broadcast(ids), i, "left_semi").withColumn("score", score) if few else texts.select(i, score.alias("score")).join(ids, i, "left_semi")
            exact = texts.select(F.col(i).alias("id"), "score")
            sure = of.where("k = 0").select("id", "is_saved", F.col("bound").alias("score"))
            every = of.select("id", "is_saved").join(exact, "id").unionByName(sure)
            return every.where("score > 0").orderBy(F.desc("is_saved"), F.desc("score"), "id").limit(limit)

        first = best(rows.orderBy(F.desc("is_saved"), F.desc("bound"), "id").limit(2 * limit), True).collect()
        if len(first) == limit:  # what cannot come before the last of these needs no look
            saved_, score = first[-1]["is_saved"], first[-1]["score"]
            rows = rows.where((F.col("is_saved") & F.lit(not saved_)) | ((F.col("is_saved") == saved_) & (F.col("bound") >= score)))
        return best(rows, False)

"""From documents to token ids: language ID, near-duplicates, repeated passages, mixing, encoding.

Each stage takes documents(doc_id, text, lang, source, n_chars, ...) and handles nulls in any column, empty and very
long texts, ties, repeated rows, empty tables and extra columns (which stay; names are compared in any case) as its
docstring says. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import langid
from paperloom.llm.common import Scratch, ship_code
from paperloom.llm.jaccard_join import near_unique
from paperloom.llm.mixing import resample
from paperloom.llm.pieces import encode_documents
from paperloom.llm.suffix_dedup import suffix_dedup

#: A document of which no language knows this share of the n-grams is in none of them.
LEAST_KNOWN = 0.2


def _aside(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one, whose names then clash with nothing."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("aside"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too) or in no known language go; so does everything if no row has
    a language to learn from. Repeated rows get equal answers; rows with a null lang or doc_id are judged like others."""
    ship_code(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.identify(_aside(docs), model, known=True)
    judged = judged.where((F.col("lang_pred") != "und") & (F.col("known_share") >= LEAST_KNOWN))
    return judged.select(*[F.col("text") if c == "text" else F.col("aside")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id (null last), of rows with one id
    that of the smaller set of shingles by its hash. Rows that share an id but not their texts are documents of their
    own. Texts without words (null, empty) are in no group and stay."""
    ship_code(spark)
    return near_unique(spark, docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, and documents that were nothing else go as a whole. Null and empty texts lose
    nothing and stay; n_chars follows the text where something went; repeated rows of 200 bytes or more empty each other."""
    ship_code(spark)
    cut = suffix_dedup(spark, _aside(docs).withColumn("missing", F.col("text").isNull()), with_text=True, with_original=False)
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    went = F.col("n_removed") > 0
    out = {c: F.col("aside")[c] for c in docs.columns if c != "text"} | {"text": F.when(~F.col("missing"), F.col("kept_text"))}
    out = {c: out[c] for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(went, F.char_length("kept_text")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[c.alias(n) for n, c in out.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Documents without words go; the null source is a source of
    its own; rows of one doc_id are taken alike."""
    ship_code(spark)
    return resample(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    ship_code(spark)
    out = encode_documents(docs.select("doc_id", "source", "lang", "text"), with_ids=True)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "exact")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the model, the schedule or the vocabulary; tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))

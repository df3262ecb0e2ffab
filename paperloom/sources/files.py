"""Readers of payload files: Atom feeds, BibTeX files and files of JSON lines, split at the borders of their records.

Spark's text reader takes the mark between two records as its line separator. It so splits a file of any size over the
tasks and hands each record to the task in whose part of the file it begins; no row holds a file, and any path that
Spark reads will do. A record's place is the path, the offset of the part it was read in and its number there, by which
the records of a file are in the file's order, however they were dealt.

Empty files and folders give no records. Files that end inside a record: the entry of a feed is dropped, as it has no
end tag; that of a BibTeX file is read up to the end of the file. Text between records is no record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources import payloads
from paperloom.sources.bibtex import read_bibtex

#: How many entries a feed is asked for, and how many relevant ones of these are kept.
FETCHED, KEPT = 60, 30
PLACE = ("path", "start", "nth")


def read_records(spark: SparkSession, path: str | Sequence[str], mark: str) -> DataFrame:
    """(record, path, start, nth, and the columns of partition folders): what stands between two marks."""
    files = spark.read.option("lineSep", mark).text(path)
    m = F.col("_metadata")
    return files.select(F.col("value").alias("record"), m["file_path"].alias("path"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("nth"), *[c for c in files.columns if c != "value"])


def read_feeds(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Canonical records of Atom feeds, with their places and the columns of partition folders."""
    r = read_records(spark, path, "<entry>")
    return payloads.arxiv(r.withColumn("xml", F.concat(F.lit("<entry>"), "record")), keep=[c for c in r.columns if c != "record"])


def read_bibtex_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Entries of BibTeX files with a title, with their places and the columns of partition folders.

    An entry ends at the first closing brace that begins a line; a row holds one entry, or a few whose braces are
    indented. An entry that has no comma before that brace has no fields, and is dropped."""
    r = read_records(spark, path, "\n}")
    return read_bibtex(r.withColumn("bibtex", F.concat("record", F.lit("\n}"))), keep=[c for c in r.columns if c != "record"])


def read_json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(doc, line, json) of files of JSON lines, one document a file; lines are ordered by their places, blank ones go."""
    r = read_records(spark, path, "\n").where(F.trim("record") != "")
    return r.select(F.col("path").alias("doc"), F.struct("start", "nth").alias("line"), F.col("record").alias("json"))


def first_relevant(records: DataFrame, feed: str, relevant: Column, fetched: int = FETCHED, kept: int = KEPT) -> DataFrame:
    """Of each feed's first `fetched` records the first `kept` relevant ones, in the order of their places.

    Each task cuts its own records of a feed to that number before any are shuffled."""
    order = Window.partitionBy(feed).orderBy(*PLACE)
    asked = records.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fetched).where(F.coalesce(relevant, F.lit(False)))
    return asked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= kept).drop("_n")

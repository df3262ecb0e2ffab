"""Stored tables: rows by key in buckets, copy-on-write, versions that one writer wins.

A table is a folder of version files and a folder of data. A version names the folder of each bucket; a write reads the
buckets that its keys fall into, writes these anew beside the old ones and creates the next version's file, which fails
if another writer has created it meanwhile. The loser's data is dropped and its change is worked out again on the
winner's version, so nothing is lost and nothing is done twice. Readers keep the version they began with.

A version also carries marks (what a stream or a source has brought so far), so data and progress change in one step: a
batch that is replayed finds its own mark and changes nothing.

Creating a file only if it is not there is atomic on HDFS and local file systems; on an object store it must be a store
with conditional writes. Keys are not null and unique in each call (of repeated ones one row is taken).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

STATUS = ("inserted", "updated", "unchanged", "refused", "deleted")


class Conflict(RuntimeError):
    """Other writers won each time."""


# ---------------------------------------------------------------- files that all see
class Files:
    """A folder of Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """False if it is there already; whoever gets True has written it alone."""
        path, body = self._path(name), text.encode()
        if self.fs.getUri().getScheme() == "file":  # whose create() looks first and writes then
            final = Path(path.toUri().getPath())
            final.parent.mkdir(parents=True, exist_ok=True)
            part = final.parent / f".{uuid.uuid4().hex}"
            part.write_bytes(body)
            try:
                os.link(part, final)
            except FileExistsError:
                return False
            finally:
                part.unlink()
            return True
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(body)
        out.close()
        return True

    def replace(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        out.write(text.encode())
        out.close()

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(n for s in self.fs.listStatus(path) if not (n := s.getPath().getName()).startswith(".")) if self.fs.exists(path) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


# ---------------------------------------------------------------- tables
@dataclass
class Version:
    number: int
    folders: dict[int, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class StoredTable:
    """schema: DDL of the columns; by: the first columns of the key, which decide a row's bucket (all of them if not given)."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str], by: Sequence[str] = (), buckets: int = 64, tries: int = 20):
        self.spark, self.key, self.by, self.buckets, self.tries = spark, list(key), list(by or key), buckets, tries
        if self.key[: len(self.by)] != self.by:
            raise ValueError(f"{self.by} must be the first columns of {self.key}")
        self.files = Files(spark, root)
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = list(self.schema.names)
        self.stored = StructType([*self.schema.fields, StructField("_status", StringType())])

    # ------------------------------------------------------------ reading
    def version(self) -> Version:
        for name in reversed(self.files.names("versions")):
            if text := self.files.read(f"versions/{name}"):  # an empty one is being written by its winner
                v = json.loads(text)
                return Version(int(name), {int(k): f for k, f in v["folders"].items()}, v["marks"])
        return Version(0)

    def _rows(self, version: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        folders = [f"{self.files.root}/data/{version.folders[b]}/bucket={b}" for b in sorted(version.folders) if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(*folders)
        return rows.where("_status <> 'deleted'").select(*self.columns)

    def read(self) -> DataFrame:
        return self._rows(self.version())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ writing
    def _commit(self, touched: Callable[[Version], list[int]], change: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None, marks: Mapping[str, int] = {}) -> dict[str, int]:
        """change gets the rows of the touched buckets and returns them with `_status`; deleted ones are not kept."""
        counts = dict.fromkeys(STATUS, 0)
        for _ in range(self.tries):
            old = self.version()
            if mark and old.marks.get(mark[0], -1) >= mark[1]:
                return counts
            buckets, folder = touched(old), uuid.uuid4().hex
            if buckets:
                rows = change(self._rows(old, buckets)).withColumn("bucket", self.bucket())
                kept = rows.withColumn("_status", F.coalesce("_status", F.lit("kept")))
                kept.repartition(len(buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.files.root}/data/{folder}")
                written = self.spark.read.schema("_status string, bucket int").parquet(f"{self.files.root}/data/{folder}")
                tally = {(r["bucket"], r["_status"]): r["n"] for r in written.groupBy("bucket", "_status").agg(F.count("*").alias("n")).collect()}  # a few a bucket
                counts |= {s: sum(n for (_, t), n in tally.items() if t == s) for s in STATUS}
                live = {b for (b, s), n in tally.items() if s != "deleted"}
            else:
                live = set()
            changed = counts["inserted"] + counts["updated"] + counts["deleted"]
            new = {b: f for b, f in old.folders.items() if b not in buckets} | {b: folder for b in live}
            all_marks = old.marks | {k: max(v, old.marks.get(k, v)) for k, v in marks.items()} | ({mark[0]: mark[1]} if mark else {})
            if not changed and all_marks == old.marks:
                self.files.delete(f"data/{folder}")
                return counts
            if not changed:
                self.files.delete(f"data/{folder}")
                new = old.folders
            if self.files.create(f"versions/{old.number + 1:020d}", json.dumps({"folders": new, "marks": all_marks})):
                return counts
            self.files.delete(f"data/{folder}")
        raise Conflict(f"{self.files.root}: {self.tries} tries")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # at most one a bucket

    def upsert(self, rows: DataFrame, may: str | None = None, keep: Sequence[str] = (), insert_only: bool = False, mark: tuple[str, int] | None = None, marks: Mapping[str, int] = {}) -> dict[str, int]:
        """New rows are inserted, others replace the row of their key; the counts of what happened.

        may: SQL over `old.` and `new.` that must hold for a row to be replaced (else it is refused); keep: columns whose
        old value stays unless it is null; insert_only: rows of known keys are refused. mark: (name, number) of this
        change, which is skipped if that or a later number of the name is in; marks: more numbers, of which the larger
        stays."""
        rows = rows.select(*self.columns).dropDuplicates(self.key)
        buckets: list[list[int]] = []

        def touched(_: Version) -> list[int]:
            if not buckets:
                buckets.append(self._touched(rows))
            return buckets[0]

        def change(old: DataFrame) -> DataFrame:
            o = old.select(*self.key, F.struct(*self.columns).alias("old"))
            n = rows.select(*self.key, F.struct(*self.columns).alias("new"))
            j = o.join(n, self.key, "full")
            allowed = F.lit(False) if insert_only else F.expr(may) if may else F.lit(True)
            merged = F.struct(*[(F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in keep else F.col(f"new.{c}")).alias(c) for c in self.columns])
            j = j.withColumn("merged", merged)
            status = (
                F.when(F.col("new").isNull(), F.lit(None)).when(F.col("old").isNull(), "inserted").when(~F.coalesce(allowed, F.lit(False)), "refused").when(F.col("merged").eqNullSafe(F.col("old")), "unchanged").otherwise("updated")
            )
            j = j.withColumn("_status", status)
            out = F.when(F.col("_status") == "inserted", F.col("new")).when(F.col("_status") == "updated", F.col("merged")).otherwise(F.col("old"))
            return j.select(out.alias("out"), "_status").select("out.*", "_status")

        return self._commit(touched, change, mark, marks)

    def delete(self, keys: DataFrame, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Rows of these keys go; a tombstone of each stays in its bucket's new folder until the next write there."""
        keys = keys.select(*self.key).distinct()

        def change(old: DataFrame) -> DataFrame:
            gone = keys.withColumn("_status", F.lit("deleted"))
            return old.join(gone, self.key, "left")

        return self._commit(lambda _: self._touched(keys), change, mark)

    def replace_children(self, parents: DataFrame, children: DataFrame, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """All rows of these parents (the columns that decide the bucket) become the children, in one version; children of
        other parents are left out."""
        parent = self.by
        parents = parents.select(*parent).distinct()
        children = children.select(*self.columns).dropDuplicates(self.key).join(parents, parent, "left_semi")

        def change(old: DataFrame) -> DataFrame:
            known = old.join(parents.withColumn("_p", F.lit(True)), parent, "left").select(*self.key, F.struct(*self.columns).alias("old"), "_p")
            j = known.join(children.select(*self.key, F.struct(*self.columns).alias("new")), self.key, "full")
            status = F.when(F.col("old").isNull(), "inserted").when(F.col("_p").isNull(), F.lit(None)).when(F.col("new").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("updated")
            return j.select(F.coalesce("new", "old").alias("out"), status.alias("_status")).select("out.*", "_status")

        return self._commit(lambda _: self._touched(parents), change, mark)

    def vacuum(self, keep: int = 2) -> int:
        """Drops all but the last versions and the data that only they name; returns how many folders went."""
        names = self.files.names("versions")
        live = {f for name in names[-keep:] for f in json.loads(self.files.read(f"versions/{name}") or '{"folders": {}}')["folders"].values()}
        gone = [f for f in self.files.names("data") if f not in live]
        for f in gone:
            self.files.delete(f"data/{f}")
        for name in names[:-keep]:
            self.files.delete(f"versions/{name}")
        return len(gone)


# ---------------------------------------------------------------- incremental ingest
def ingest(rows: DataFrame, table: StoredTable, checkpoint: str, name: str, by: Sequence[str], at: str, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows, may: str | None = None) -> None:
    """Upserts a stream of rows into a table, batch by batch, with the progress of each `by` (source, direction): the
    largest `at` (a whole number) so far is committed with the data it stands for. A replayed batch changes nothing.
    fold: makes one row a key of a batch; may: as in upsert."""
    from paperloom.streaming.stateful import run_available

    def write(frame: DataFrame, batch: int) -> None:
        far = frame.groupBy(*by).agg(F.max(at).alias("m")).collect()  # sources times directions
        marks = {"/".join([name, *(str(r[c]) for c in by)]): int(r["m"]) for r in far if r["m"] is not None}
        table.upsert(fold(frame), may, mark=(name, batch), marks=marks)

    run_available(rows, checkpoint, "append", write)


def progress(table: StoredTable, name: str) -> dict[tuple[str, ...], int]:
    """What each (source, direction) has come to."""
    head = f"{name}/"
    return {tuple(k[len(head) :].split("/")): v for k, v in table.version().marks.items() if k.startswith(head)}

"""Shared machinery: scratch tables, re-readable blocks of rows, fingerprints, and a bucketed count exchange.

Several operators have to look at a text more than once (count something over the whole corpus, then act on the
counts). Shuffling texts for every look would move the corpus again and again, so rows are packed once into *blocks*
(half a MB of text as compressed Arrow) that lie in a bucketed table, and each look ships only fingerprints to hash buckets
and small replies back to the blocks.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
BUCKET_BYTES = 16 << 20
U64 = np.uint64


# ---------------------------------------------------------------- scratch
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only in local mode, as in tests, a temporary one if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written intermediate tables of one operator run; a table is dropped as soon as nothing reads it any more.

    As a context manager it drops what is left at the end, but for results; after an error these go too. Results are
    read by whoever called the operator, so they stay until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/paperloom-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        self.names: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, error, *_) -> None:
        self.drop(*(n for n in sorted(self.names) if error or n != "result"))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        _RESULTS.append((self.spark, self.root))
        return self.write(df, "result")

    def write_bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """One file a bucket: rows go to their bucket's task first."""
        table = f"paperloom_{name}_{uuid.uuid4().hex}"
        self.names.add(name)
        self.tables[name] = table
        df.repartition(n, key).write.option("path", f"{self.root}/{name}").bucketBy(n, key).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            with contextlib.suppress(Exception):  # a leftover costs disk, not results
                _delete(self.spark, f"{self.root}/{name}")
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner remove shuffles nobody reads any more


_RESULTS: list = []


@atexit.register
def _sweep() -> None:
    for spark, root in _RESULTS:
        with contextlib.suppress(Exception):
            _delete(spark, root)


MOST_BUCKETS = 50_000  # of a table; Spark's own limit is twice that


def table_bytes(df: DataFrame, text: str = "text") -> int:
    """Size as the optimizer knows it; where it doesn't (no files underneath), the texts are measured."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]


def partitions_for(spark: SparkSession, n_bytes: int, each: int = BUCKET_BYTES) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


# ---------------------------------------------------------------- blocks
def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _blocks(describe, text: str):
    def cut(batches):
        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        schema = None

        def flush():
            nonlocal k, held, size
            table = pa.Table.from_batches(held)
            out = {"block": pa.array([(task << 32) | k], pa.int64()), "part": pa.array([pack(table)], pa.binary())}
            out |= {"n_bytes": pa.array([size], pa.int64())}
            if describe:
                out["docs"] = pa.array([describe(table)], pa.list_(describe.type))
            k, held, size = k + 1, [], 0
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            schema = batch.schema
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(schema.get_field_index(text))), 0)
            ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = int(np.searchsorted(ends, base + BLOCK_BYTES - size)) + 1
                to = max(at + 1, min(to, batch.num_rows))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
                if size >= BLOCK_BYTES or sum(b.num_rows for b in held) >= 20_000:
                    yield flush()
        if held:
            yield flush()

    return cut


def blocks_of(scratch: Scratch, df: DataFrame, text: str = "text", describe=None, describe_ddl: str = "") -> DataFrame:
    """Packs all rows of df into a bucketed table (block, part, n_bytes[, docs]); texts are shuffled this once, packed."""
    import pyarrow.compute  # noqa: F401

    n = min(MOST_BUCKETS, partitions_for(scratch.spark, table_bytes(df, text)))
    ddl = "block long, part binary, n_bytes long" + (f", docs array<{describe_ddl}>" if describe else "")
    return scratch.write_bucketed(df.mapInArrow(lean("blocks")(_blocks(describe, text)), ddl), "blocks", "block", n)


class Texts:
    """The texts of a block as one byte array: bytes, starts and lengths (null texts are empty)."""

    def __init__(self, table: pa.Table, text: str = "text"):
        col = table.column(text).combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
        col = pa.compute.fill_null(col.cast(pa.large_string()), "")
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = col.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[off[0] : off[-1]]
        self.starts = off[:-1] - off[0]
        self.lens = np.diff(off)


# ---------------------------------------------------------------- fingerprints
def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (public-domain splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(seed: int, n: int) -> np.ndarray:
    return splitmix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Roller:
    """Polynomial fingerprints mod 2^64 of substrings of one byte array, from prefix sums over a random byte table."""

    _powers: dict[int, list[np.ndarray]] = {}
    BASE, SECOND = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5

    def __init__(self, data: np.ndarray, seed: int, base: int = BASE):
        n = len(data)
        powers = self._powers.get(base)
        if not powers or len(powers[0]) < n + 1:
            size = max(n + 1, BLOCK_BYTES + (BLOCK_BYTES >> 3))
            bases = (base, pow(base, -1, 1 << 64))
            powers = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, dtype=U64)]), dtype=U64) for b in bases]
            if n <= 2 * BLOCK_BYTES:  # kept for the next blocks of this worker, unless one long text needed more
                Roller._powers[base] = powers
        self.inverse = powers[1]
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_table(seed, 256)[data] * powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return splitmix((self.sums[end] - self.sums[start]) * self.inverse[start] + np.asarray(end - start).astype(U64))


# ---------------------------------------------------------------- exchange
def ranges(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return cut, np.append(cut[1:], len(sorted_keys))


def low40(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def from40(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").reshape(-1).astype(U64, copy=False)


def bucket_key(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket in the high bits, 40 bits of the fingerprint below: sorting it deals the fingerprints out."""
    return ((h >> U64(40)) % U64(n_buckets) << U64(40)) | (h & U64((1 << 40) - 1))


class Distinct:
    """The distinct bucket keys of a block, with how often each occurs (pre-aggregation before the shuffle)."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        s = keys[self.order]
        self.first, end = ranges(s)
        self.keys, self.counts = s[self.first], (end - self.first)
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[self.order] = np.repeat(np.arange(len(self.first)), self.counts)

    def messages(self, block: int):
        bucket = (self.keys >> U64(40)).astype(np.int64)
        for a, b in zip(*ranges(bucket)):
            yield int(bucket[a]), block, low40(self.keys[a:b]).tobytes(), np.minimum(self.counts[a:b], 255).astype(np.uint8).tobytes()

    def answers(self, replies, n_buckets: int) -> np.ndarray:
        """Replies (bucket, bytes) put in the order of the distinct keys: one code per key."""
        if not len(self.keys):
            return np.zeros(0, np.uint8)
        return np.frombuffer(b"".join(r["codes"] for r in sorted(replies, key=lambda r: r["bucket"])), np.uint8)


MESSAGE = "bucket int, block long, keys binary, counts binary"
REPLY = "block long, bucket int, codes binary"


def message_frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "counts"])


def count_codes(total: np.ndarray) -> np.ndarray:
    """0 for a key seen once, else 1 + 4 * log2(times), at most 255: counts to within a fifth."""
    codes, some = np.zeros(len(total), np.uint8), np.flatnonzero(total > 1)
    codes[some] = np.minimum(1 + np.floor(4 * np.log2(total[some])), 255)
    return codes


def _count_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    at = np.cumsum([0, *map(len, frame["counts"])])
    keys = from40(b"".join(frame["keys"]))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first, end = ranges(keys)
    del keys  # a worker lives on beside others: what it takes at most counts
    end -= first
    total = count_codes(np.add.reduceat(np.frombuffer(b"".join(frame["counts"]), np.uint8)[order], first, dtype=np.int64))
    del first
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.repeat(total, end)
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "codes": [codes[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]})


def by_block(replies: DataFrame) -> DataFrame:
    names = [c for c in replies.columns if c != "block"]
    return replies.groupBy("block").agg(F.collect_list(F.struct(*names)).alias("replies"))


def attach(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with their replies; the bucketed blocks stay where they are, only the replies are shuffled."""
    return blocks.join(replies.hint("shuffle_hash"), "block", "left")


def exchange_counts(messages: DataFrame) -> DataFrame:
    return by_block(messages.groupBy("bucket").applyInPandas(lean_group(_count_bucket), REPLY))


# ---------------------------------------------------------------- columns
def at_most(bounds: list, column, kind: str):
    """How many of the ascending bounds are at most the value, by binary search; 0 for null. One folded literal."""
    if not bounds:
        return F.lit(0)
    table, steps = F.split(F.lit(",".join(map(repr, bounds))), ",").cast(f"array<{kind}>"), [1]
    while steps[-1] * 2 <= len(bounds):
        steps.append(steps[-1] * 2)
    return F.aggregate(F.array(*map(F.lit, reversed(steps))), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(table, lo + s - 1) <= column), lo + s).otherwise(lo))


def extended(schema, fields):
    """A schema with fields added at the end; they replace fields of the same name (in any case)."""
    from pyspark.sql.types import StructType

    new = {f.name.lower() for f in fields}
    return StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def put_columns(batch: pa.RecordBatch, new: dict) -> pa.RecordBatch:
    """The same for a batch."""
    low = {n.lower() for n in new}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in low]
    names, arrays = zip(*kept, *new.items())
    return pa.RecordBatch.from_arrays(list(arrays), names=list(names))


# ---------------------------------------------------------------- code on executors
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that they need no shared installation."""
    import zipfile
    from pathlib import Path

    if spark.conf.get(ROWS) == "10000":  # unless set by the user: long texts make batches of 10,000 rows large
        spark.conf.set(ROWS, "2000")
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = f"{tempfile.mkdtemp(prefix='paperloom-')}/paperloom.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"paperloom/{p.relative_to(top)}")
    sc.addPyFile(name)
    sc._paperloom_shipped = True


# ---------------------------------------------------------------- memory of Python workers
CLEAR: list = []  # called when another operator takes over a worker
_NOW = [""]


def trim() -> None:
    """Gives freed memory back to the system, as a worker lives on beside the next operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(operator: str):
    """Wraps an iterator function for workers: caches of other operators go first, freed memory goes back after."""

    def wrap(function):
        def run(batches):
            start_operator(operator)
            yield from function(batches)
            trim()

        return run

    return wrap


def lean_group(function):
    """Wraps a function of one large group: memory freed since the last group goes back before, its own after."""

    def run(frame):
        start_operator(_NOW[0] or "group")
        trim()
        out = function(frame)
        trim()
        return out

    return run


def start_operator(operator: str) -> None:
    if not _NOW[0]:
        with contextlib.suppress(OSError, AttributeError):
            import ctypes

            ctypes.CDLL("libc.so.6").mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD: arrays from 2 MB go back when freed
    if _NOW[0] != operator:
        _NOW[0] = operator
        for clear in CLEAR:
            clear()
        trim()


CLEAR.append(lambda: Roller._powers.clear())

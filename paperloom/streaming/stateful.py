"""Streams with state: leases with event-time timers, folded user state, decayed preferences, and an idempotent sink.

A run with the trigger `availableNow` takes what is there and ends; started again on its checkpoint, it goes on where it
ended. Sinks are idempotent by batch id: a batch that is replayed after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.cluster import ship_code

#: Days of which a preference loses a factor of e, and the day that stored sums are scaled to.
DECAY_DAYS, ORIGIN = 90.0, "2020-01-01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# ---------------------------------------------------------------- running
def run_available(rows: DataFrame, checkpoint: str, mode: str, write) -> None:
    """One availableNow run of a stream; write(frame, batch_id) is called for each batch."""
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


class BatchTable:
    """Rows of a stream by batch, a folder each: a replayed batch overwrites its folder, so nothing is there twice."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self) -> DataFrame:
        """Everything appended so far, with its batch."""
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def latest(self, *key: str) -> DataFrame:
        """The last update of each key (of a stream in update mode)."""
        r = self.rows()
        return r.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))).where("_r = 1").drop("_r", "batch")


# ---------------------------------------------------------------- folds
def stream_flags(events: DataFrame) -> DataFrame:
    """(paper_id, last_event, ever_saved, n) per paper, an aggregate whose state is one row a paper."""
    from paperloom.streaming.events import fold_state

    return fold_state(events)


def stream_decayed_sums(events: DataFrame) -> DataFrame:
    """(direction, scaled) over events(direction, created_at, weight): the sum of weights, each as if it had grown from
    ORIGIN on. Sums don't hang on the order of events, so late and repeated batches change nothing but the state."""
    days = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))) / 86_400e6
    return events.groupBy("direction").agg(F.sum(F.col("weight") * F.exp(days / DECAY_DAYS)).alias("scaled"))


def preference_at(sums: DataFrame, as_of: str) -> DataFrame:
    """(direction, score): what the stored sums are worth at a time."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))) / 86_400e6
    return sums.select("direction", (F.col("scaled") * F.exp(-days / DECAY_DAYS)).alias("score"))


# ---------------------------------------------------------------- leases
#: The id of an expiry, which no command caused.
NO_COMMAND = -1
LEASES = "job long, at long, id long, command string, worker long, outcome string"


class Leases(StatefulProcessor):
    """Commands of one job (claim, heartbeat, finish, fail) in the order of their event times, whatever order they came in.

    Commands wait in state until the watermark has passed them. A claim succeeds if no lease is live, and a lease is live
    up to and including its last microsecond; all others need the worker that holds the lease. A heartbeat renews, finish
    and fail end it. A lease that nobody renews expires by a timer, which is a row of its own. A job without a lease and
    without waiting commands leaves no state.
    """

    def __init__(self, lease_us: int):
        self.lease_us = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker long, until long")
        self.waiting = handle.getListState("waiting", "at long, id long, command string, worker long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.us), int(r.id), str(r.command), int(r.worker)) for f in rows for r in f.itertuples()]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in waiting if r[0] < now], [r for r in waiting if r[0] >= now]
        held = self.lease.get() if self.lease.exists() else None
        worker, until = (held[0], held[1]) if held else (None, None)
        out = []

        def expire(before: int) -> None:
            nonlocal worker, until
            if worker is not None and until < before:
                out.append((key[0], until, NO_COMMAND, "expire", worker, "expired"))
                worker, until = None, None

        for at, id_, command, who in due:
            expire(at)
            free = worker is None
            ok = free if command == "claim" else worker == who
            out.append((key[0], at, id_, command, who, ("claimed" if command == "claim" else "done") if ok else "refused"))
            if ok and command in ("claim", "heartbeat"):
                worker, until = who, at + self.lease_us
            elif ok:
                worker, until = None, None
        expire(now)
        if worker is None:
            self.lease.clear()
        else:
            self.lease.update((worker, until))
            self.handle.registerTimer(until // 1000 + 1)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["job", "at", "id", "command", "worker", "outcome"])

    def close(self) -> None:
        pass


def stream_leases(commands: DataFrame, lease_s: int = 900, late: str = "10 minutes") -> DataFrame:
    """Outcomes (job, at in microseconds, id, command, worker, outcome) of a stream of commands(job, at timestamp, id,
    command, worker). Rows later than the watermark are dropped by Spark; all others are judged by event time."""
    spark = commands.sparkSession
    ship_code(spark)
    spark.conf.set(PROVIDER, ROCKS)  # timers and lists live in RocksDB, not on the heap
    c = commands.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return c.groupBy("job").transformWithStateInPandas(Leases(lease_s * 1_000_000), LEASES, "append", "eventtime")


def run_leases(commands: DataFrame, folder: str, **kw) -> DataFrame:
    """Runs what is there (twice: the second run has no rows, but the watermark of the first) and returns all outcomes."""
    spark = commands.sparkSession
    table = BatchTable(spark, f"{folder}/outcomes", LEASES)
    for _ in range(2):
        run_available(stream_leases(commands, **kw), f"{folder}/checkpoint", "append", table.write)
    return table.rows().drop("batch")

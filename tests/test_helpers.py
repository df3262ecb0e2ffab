"""Job helpers, hashes, decay over a stream, quality columns against the plain scan, bindings of many captions."""

from __future__ import annotations

import math
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import documents as doc
from paperloom.operators import jobs
from paperloom.operators import structure as st
from paperloom.streaming import events as ev

DATA = "/root/testdata/sf0.001"


def test_retries_ask_the_server():
    now = datetime(2024, 2, 1, tzinfo=None).timestamp()
    assert jobs.retry_after_seconds("7", now) == 7 and jobs.retry_after_seconds("soon", now) is None and jobs.retry_after_seconds(None, now) is None
    assert jobs.retry_after_seconds("Thu, 01 Feb 2024 00:00:30 GMT", 1706745600) == 30 and jobs.retry_after_seconds("Wed, 31 Jan 2024 00:00:00 GMT", 1706745600) == 0
    slept, answers = [], iter([jobs.ServiceError(429, "3"), TimeoutError(), "ok"])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert jobs.with_retries(call, sleep=slept.append) == "ok" and slept[0] == 3 and 0 < slept[1] <= 60
    with pytest.raises(jobs.ServiceError):
        jobs.with_retries(lambda: (_ for _ in ()).throw(jobs.ServiceError(404)), sleep=slept.append)
    assert len(slept) == 2


def test_heartbeat_tells_a_lost_lease():
    beats = []
    with jobs.heartbeat(lambda: beats.append(1) or len(beats) < 3, 0.01) as lost:
        assert lost.wait(5)
    n = len(beats)
    time.sleep(0.05)
    assert n == 3 == len(beats)
    assert jobs.next_run(datetime(2024, 1, 31, 9)) == datetime(2024, 2, 1, 8) and jobs.next_run(datetime(2024, 1, 31, 7)) == datetime(2024, 1, 31, 8)


def test_hashes_and_assets(spark):
    df = spark.createDataFrame([("t", None, "v", 2020, "![a](assets/x.png) ![b](http://y.png)")], "title string, abstract string, venue string, year int, md string")
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    kinds = [tx.result_hash(k, get).alias(k) for k in tx.HASHED]
    r = df.select(*kinds, tx.served_assets(F.col("md"), F.lit("/files/")).alias("md"), tx.content_type(F.lit("A.PNG")).alias("type"), tx.summary_display(F.lit("x" * 300)).alias("s"), F.length(tx.chunk_hash(F.lit("h"), F.lit(1), F.lit("t"))).alias("n")).first()
    assert len({r[k] for k in tx.HASHED}) == 4 and r["md"] == "![a](/files/x.png) ![b](http://y.png)" and r["type"] == "image/png" and r["s"] == "x" * 280 + "..." and r["n"] == 20


def test_decay_does_not_depend_on_batches():
    r = random.Random(2)
    events = [(r.uniform(0, 200), r.choice([3.0, 1.0, -4.0])) for _ in range(40)]
    end = max(t for t, _ in events)
    want = sum(w * math.exp(-(end - t) / 90) for t, w in events)
    state = None
    for k in range(0, 40, 7):
        state = ev.decayed(state, events[k : k + 7])
    assert state[1] == end and state[0] == pytest.approx(want)


def test_preference_stream(spark, tmp_path):
    rows = [("a", "2024-01-01", 3.0), ("b", "2024-01-02", 1.0), ("a", "2024-01-31", 1.0)]
    spark.createDataFrame(rows, "direction string, d string, weight double").select("direction", F.to_timestamp("d").alias("created_at"), "weight").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("direction string, created_at timestamp, weight double").parquet(f"{tmp_path}/in")
    q = ev.stream_preference(src).writeStream.outputMode("update").format("memory").queryName("liked").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["direction"]: r["score"] for r in spark.table("liked").collect()}
    assert got["b"] == 1 and got["a"] == pytest.approx(1 + 3 * math.exp(-30 / 90))


def test_quality_columns_equal_the_plain_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown"))
    odd = [(-1, "ab" * 30 + " and more"), (-2, "igure 1\n<table><tr><td>"), (-3, "x" * 6001 + "\n" + "<table>" + "y" * 6001 + "</table>"), (-4, "$a$ and $ b"), (-5, None), (-6, "abcd" * 10 + " tail " * 200), (-7, "one\r\n\r\nnter here $$x$$")]
    docs = docs.unionByName(spark.createDataFrame(odd, "id long, markdown string"))
    want = {r["id"]: doc.inspect(r["markdown"] or "") for r in docs.collect()}
    got = {r["id"]: list(r["issues"]) for r in doc.inspect_documents(docs).collect()}
    assert got == want and any(want.values())


def test_many_captions_bind_in_order():
    text = "\n\n".join(f"![a](p{k}.png)\n\nFigure {k}: Caption {k}.\n\n{'word ' * 50}" for k in range(1, 400))
    start = time.perf_counter()
    found, review = st.bind(text)
    assert time.perf_counter() - start < 5 and review == [] and [o.caption_number for o in found] == list(range(1, 400))

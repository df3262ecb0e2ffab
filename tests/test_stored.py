"""Stored tables, races for a version or a day, replayed batches, and streams with late rows and restarts."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from paperloom.operators.daily import Snapshots
from paperloom.operators.stored import Files, StoredTable, ingest, progress
from paperloom.streaming import stateful as st


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, f"file://{tmp_path}/t", "k long, v string, n int", ["k"], buckets=8)


def _df(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string, n int")


def _all(table):
    return {r["k"]: (r["v"], r["n"]) for r in table.read().collect()}


def test_upserts_count_what_they_did(spark, table):
    assert table.read().count() == 0
    assert table.upsert(_df(spark, (1, "a", 1), (2, "b", 2), (3, None, 3)))["inserted"] == 3
    got = table.upsert(_df(spark, (1, "a", 1), (2, "x", 1), (3, "c", 9), (4, "d", 4)), may="new.n > old.n")
    assert (got["inserted"], got["updated"], got["unchanged"], got["refused"]) == (1, 1, 0, 2)
    assert _all(table) == {1: ("a", 1), 2: ("b", 2), 3: ("c", 9), 4: ("d", 4)}
    assert table.upsert(_df(spark, (1, "a", 1)))["unchanged"] == 1 and table.version().number == 2
    assert table.upsert(_df(spark, (1, "z", 5)), insert_only=True)["refused"] == 1
    assert table.upsert(_df(spark, (1, "z", 5)), keep=["v"])["updated"] == 1 and _all(table)[1] == ("a", 5)
    assert table.delete(_df(spark, (1, "", 0), (99, "", 0)))["deleted"] == 1 and 1 not in _all(table)
    assert table.upsert(_df(spark, (1, "again", 1)))["inserted"] == 1


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(400).select(F.col("id").alias("k"), F.lit("v").alias("v"), F.lit(0).alias("n")))
    before = table.version().folders
    table.upsert(_df(spark, (7, "new", 1)))
    after = table.version().folders
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    old = table.read()
    table.upsert(_df(spark, (8, "newer", 1)))
    assert old.where("k = 8").first()["v"] == "v"  # readers keep their version
    table.upsert(_df(spark, (8, "newest", 2)))
    assert table.vacuum(keep=1) >= 1 and _all(table)[8] == ("newest", 2) and table.read().count() == 400


def test_children_are_replaced_as_a_whole(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/c", "p long, c string", ["p", "c"], by=["p"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "x")], "p long, c string"))
    got = t.replace_children(spark.createDataFrame([(1,), (3,)], "p long"), spark.createDataFrame([(1, "b"), (1, "c"), (2, "no")], "p long, c string"))
    assert (got["inserted"], got["deleted"], got["unchanged"]) == (1, 2, 1)
    assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (1, "c"), (2, "a")]


def test_of_writers_at_the_same_time_none_is_lost(spark, table):
    table.upsert(_df(spark, (0, "", 0)))
    threads = [threading.Thread(target=lambda i=i: table.upsert(_df(spark, (0, "", i), (i, str(i), i)), may="new.n > old.n")) for i in range(1, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert _all(table) == {0: ("", 5)} | {i: (str(i), i) for i in range(1, 6)}
    assert table.version().number == len(table.files.names("versions"))


def test_a_marked_change_happens_once(spark, table):
    assert table.upsert(_df(spark, (1, "a", 1)), mark=("s", 3))["inserted"] == 1
    assert sum(table.upsert(_df(spark, (1, "b", 2)), mark=("s", 3)).values()) == 0
    assert sum(table.upsert(_df(spark, (1, "b", 2)), mark=("s", 2)).values()) == 0
    assert table.upsert(_df(spark, (1, "b", 2)), mark=("s", 4), marks={"s/x": 7})["updated"] == 1
    assert table.version().marks == {"s": 4, "s/x": 7}


def test_one_of_many_creates_a_file(spark, tmp_path):
    files, won = Files(spark, f"file://{tmp_path}"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create("a/b", str(i)) else None) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read("a/b") == str(won[0]) and files.names("a") == ["b"]


def test_two_first_calls_of_a_day_give_one_snapshot(spark, tmp_path):
    snaps, both, got = Snapshots(spark, f"file://{tmp_path}"), threading.Barrier(2), []

    def call(i):
        def compute():
            both.wait(60)
            return spark.createDataFrame([(i, i)], "paper_id long, pick int")

        got.append(snaps.of("2024-02-01", "all", compute).collect())

    threads = [threading.Thread(target=call, args=(i,)) for i in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got[0] == got[1] and len(got[0]) == 1
    assert len(snaps.files.names("day=2024-02-01/window=all")) == 2  # the pointer and one folder
    snaps.forget("2024-02-01", got[0][0]["paper_id"])
    assert snaps.of("2024-02-01", "all", lambda: 1 / 0).count() == 0
    snaps.forget("2024-02-01")
    assert snaps.of("2024-02-01", "all", lambda: spark.createDataFrame([(9, 9)], "paper_id long, pick int")).first()["pick"] == 9


# ---------------------------------------------------------------- streams
def _put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_ingest_goes_on_and_a_replay_changes_nothing(spark, tmp_path):
    schema, folder = "k long, v string, n int", f"{tmp_path}/in"
    t = StoredTable(spark, f"file://{tmp_path}/t", schema, ["k"], buckets=4)
    _put(spark, folder, "a", [(1, "s", 5), (2, "s", 3)], schema)
    run = lambda check: ingest(_stream(spark, folder, schema), t, f"file://{tmp_path}/{check}", "sync", ["v"], "n", may="new.n > old.n")
    run("c")
    _put(spark, folder, "b", [(2, "s", 9), (3, "r", 1)], schema)
    run("c")
    assert _all(t) == {1: ("s", 5), 2: ("s", 9), 3: ("r", 1)} and progress(t, "sync") == {("s",): 9, ("r",): 1}
    number = t.version().number
    run("lost")  # the checkpoint is lost: the same batches come again
    assert t.version().number == number


LEASE = "job long, at timestamp, id long, command string, worker long"


def _leases(rows, lease_s):
    """Outcomes of one job's commands in order, and what expired between them."""
    out, held, until = [], None, None
    for at, id_, command, who in sorted(rows):
        if held is not None and until < at:
            out.append((until, -1, "expired"))
            held = None
        ok = held is None if command == "claim" else held == who
        out.append((at, id_, ("claimed" if command == "claim" else "done") if ok else "refused"))
        if ok:
            held, until = (who, at + lease_s) if command in ("claim", "heartbeat") else (None, None)
    return out, (held, until)


def test_leases_by_event_time_over_batches_restarts_and_late_rows(spark, tmp_path):
    import datetime as dt
    import random

    r, folder = random.Random(4), f"{tmp_path}/in"
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = [(j, t, j * 1000 + t, r.choice(["claim", "heartbeat", "finish", "fail", "claim"]), r.randrange(2)) for j in range(4) for t in sorted(r.sample(range(0, 4000, 7), 40))]
    rows.sort(key=lambda x: x[1] + r.uniform(0, 250))  # out of order, but less than the watermark lets by
    third = len(rows) // 3
    outcomes = lambda: st.run_leases(_stream(spark, folder, LEASE), f"file://{tmp_path}/run", lease_s=200, late="5 minutes")
    for k in range(3):
        _put(spark, folder, f"f{k}", [(j, at(t), i, c, w) for j, t, i, c, w in rows[k * third : (k + 1) * third if k < 2 else None]], LEASE)
        outcomes()
    _put(spark, folder, "late", [(0, at(1), 77, "claim", 0)], LEASE)  # far behind the watermark
    _put(spark, folder, "last", [(9, at(90_000), 1, "claim", 0)], LEASE)  # lets all others pass
    got = [((x["at"] / 1e6 - at(0).timestamp()), x["id"], x["outcome"], x["job"]) for x in outcomes().collect()]
    assert 77 not in [g[1] for g in got]
    for j in range(4):
        want, (held, until) = _leases([(t, i, c, w) for k, t, i, c, w in rows if k == j], 200)
        want += [(until, -1, "expired")] if held is not None else []
        assert sorted((g[:3] for g in got if g[3] == j), key=str) == sorted(((float(a), i, o) for a, i, o in want), key=str)


def test_streamed_sums_do_not_hang_on_order(spark, tmp_path):
    schema, folder = "direction string, created_at timestamp, weight double", f"{tmp_path}/in"
    import datetime as dt
    import math

    rows = [("a", dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc), float(d)) for d in (20, 3, 11, 28)]
    table = st.BatchTable(spark, f"file://{tmp_path}/t", "direction string, scaled double")
    for k, row in enumerate(rows):
        _put(spark, folder, f"f{k}", [row], schema)
        st.run_available(st.stream_decayed_sums(_stream(spark, folder, schema)), f"file://{tmp_path}/c", "update", table.write)
    score = st.preference_at(table.latest("direction"), "2024-02-01").first()["score"]
    assert score == pytest.approx(sum(w * math.exp(-(32 - d.day) / 90) for _, d, w in rows), rel=1e-9)

"""The append-only event log: state folding, daily windows as a stream, and the leased-job state machine."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_S = 300


def fold_state(events: DataFrame) -> DataFrame:
    """Per paper the last event (by time, then id), whether it was ever saved, and the number of events."""
    return events.groupBy("paper_id").agg(
        F.max_by("event", F.struct("created_at", "id")).alias("last_event"), F.max(F.when(F.col("event") == "save", 1).otherwise(0)).alias("ever_saved"), F.count("*").alias("n")
    )


def stream_state(events: DataFrame) -> DataFrame:
    """The same over a stream, in update or complete mode: the aggregate's state is one row per paper."""
    return fold_state(events)


def stream_daily_counts(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts per key and day over a stream; a day is final once the watermark passes it."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def decayed(state: tuple[float, float] | None, events, half: float = 90.0) -> tuple[float, float]:
    """(score, day) after events (day, weight), of whatever order: a score decays by exp(-days / 90) between them."""
    score, day = state or (0.0, float("-inf"))
    for at, weight in events:
        if at >= day:
            score, day = score * math.exp(-(at - day) / half) + weight if score else weight, at
        else:  # a late event counts as it would have decayed until now
            score += weight * math.exp(-(day - at) / half)
    return score, day


def stream_preference(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(direction, score, day) over a stream of events(direction, created_at, weight), in update mode: the state of a
    direction is its score and the day it stands for, so that a preference at any later time is score * exp(-days / 90)."""

    def update(key, frames, state):
        rows = [(t.timestamp() / 86400, float(w)) for f in frames for t, w in zip(f["created_at"], f["weight"])]
        now = decayed(state.get if state.exists else None, rows)
        state.update(now)
        yield pd.DataFrame({"direction": [key[0]], "score": [now[0]], "day": [now[1]]})

    e = events.withWatermark("created_at", late)
    return e.groupBy("direction").applyInPandasWithState(update, "direction string, score double, day double", "score double, day double", "update", "NoTimeout")


def _lease(frame: pd.DataFrame) -> pd.DataFrame:
    status, token, lease, out = None, None, None, []
    for r in frame.sort_values("seq").itertuples():
        live = status in ("pending", "running") and lease is not None and lease >= r.at
        if r.command == "claim":
            ok = not live
            if ok:
                status, token, lease = "pending", r.token, r.at + LEASE_S
            out.append((r.seq, r.paper_id, "claimed" if ok else "refused", status))
            continue
        owner = token is not None and r.token == token  # a stale token touches nothing
        if owner and r.command in ("start", "heartbeat", "progress"):
            status, lease = "running", r.at + LEASE_S
        elif owner and r.command in ("finish", "fail"):
            status, token, lease = ("completed" if r.command == "finish" else "failed"), None, None
        elif r.command == "expire":
            owner = status in ("pending", "running") and lease is not None and lease < r.at
            if owner:
                status, token, lease = "failed", None, None
        out.append((r.seq, r.paper_id, "done" if owner else "refused", status))
    return pd.DataFrame(out, columns=["seq", "paper_id", "outcome", "status"])


def run_lease_commands(commands: DataFrame) -> DataFrame:
    """Outcome of every command (claim, start, heartbeat, progress, finish, fail, expire) per job, in order of seq.

    A claim succeeds if no lease is live (a lease is live up to and including its last second); other commands need
    the token of the current claim.
    """
    return commands.groupBy("paper_id").applyInPandas(_lease, "seq int, paper_id long, outcome string, status string")

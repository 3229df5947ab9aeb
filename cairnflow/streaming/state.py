"""Keyed state over event streams: exact sliding-window limiter, tumbling and session windows with late data, session profiles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limited(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(user_id, ts, event_id) -> with allowed. A refused request uses no quota, so this is state and not a count. Works on batches and streams."""
    schema = "user_id long, event_id long, ts timestamp, allowed boolean"

    def decide(rows: pd.DataFrame, recent: list) -> tuple[pd.DataFrame, list]:
        out = []
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            recent = [t for t in recent if (r.ts - t).total_seconds() < seconds]
            ok = len(recent) < limit
            if ok:
                recent.append(r.ts)
            out.append((r.user_id, r.event_id, r.ts, ok))
        return pd.DataFrame(out, columns=["user_id", "event_id", "ts", "allowed"]), recent

    slim = events.select("user_id", "event_id", "ts")
    if not events.isStreaming:
        return slim.groupBy("user_id").applyInPandas(lambda pdf: decide(pdf, [])[0], schema)

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = [pd.Timestamp(t) for t in state.get[0]] if state.exists else []
        out, recent = decide(pd.concat(list(frames)), recent)
        state.update(([t.isoformat() for t in recent],))
        state.setTimeoutDuration(seconds * 1000)
        yield out

    return slim.groupBy("user_id").applyInPandasWithState(step, schema, "recent array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by window and type; later than the watermark is dropped on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def profiles(events: DataFrame) -> DataFrame:
    """The latest kind of feedback per user and item: a title has one kind at a time."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("at"))

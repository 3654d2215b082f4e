"""Streaming twins of operators.sessions, by event time so that a replay gives the batch results; leases with timers are in leases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counters(calls: DataFrame, session: str) -> DataFrame:
    """Running totals a session, for update mode."""
    return calls.groupBy(session).agg(F.count("*").alias("calls"), (F.sum("before") - F.sum("after")).alias("saved_chars"))


def stream_leases(events: DataFrame, session: str, ts: str, ttl: str, delay: str = "1 hour") -> DataFrame:
    """Leases, each emitted when the watermark has passed its end, for append mode. Events later than the delay are dropped."""
    return events.withWatermark(ts, delay).groupBy(session, F.session_window(ts, ttl)).agg(F.count("*").alias("beats"), F.min(ts).alias("opened"), F.max(ts).alias("last_beat")).drop("session_window")

"""Counts over the query log; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, lateness: str | None) -> DataFrame:
    return events.withWatermark("ts", lateness) if lateness and events.isStreaming else events


def window_counts(events: DataFrame, size: str, slide: str | None = None, lateness: str | None = "1 hour") -> DataFrame:
    """Tumbling (or sliding) counts and value totals per event type; rows later than `lateness` are dropped in streams."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events, lateness).groupBy(win.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, lateness: str | None = "1 hour") -> DataFrame:
    """Sessions per user: a session ends after `gap` without events."""
    return _timed(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n")
    ).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

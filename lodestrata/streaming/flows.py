"""Flows and bursts of event streams, with a watermark; they equal the batch forms once all events are in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_flows(events: DataFrame, keys: Sequence[str], time: str, size: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Flows of each window (A1): packets, bytes, first and last time by key."""
    timed = events.withWatermark(time, late)
    out = timed.groupBy(F.window(time, window), *keys).agg(
        F.count("*").alias("packets"), F.sum(size).alias("bytes"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")
    )
    return out.select(F.col("window.start").alias("window_start"), *keys, "packets", "bytes", "first_seen", "last_seen")


def stream_bursts(events: DataFrame, keys: Sequence[str], time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events that follow each other within a gap (W8), as session windows."""
    timed = events.withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("events"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return out.select(*keys, "events", "first_seen", "last_seen")

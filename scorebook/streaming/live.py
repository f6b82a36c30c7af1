"""Structured Streaming forms of event rollups: late events count until the watermark passes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, keys: Sequence[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """One row per key; state is dropped once the watermark has passed."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def window_totals(events: DataFrame, entity: str, time: str, value: str, length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(entity, window_start, window_end, events, total) per tumbling or sliding window."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = events.withWatermark(time, lateness).groupBy(F.col(entity), w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(entity, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "total")


def sessions(events: DataFrame, entity: str, time: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(entity, session_start, session_end, events): runs of events with no pause of `gap`."""
    out = events.withWatermark(time, lateness).groupBy(F.col(entity), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(entity, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")

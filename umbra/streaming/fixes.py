"""Structured Streaming over position fixes (user_id, ts, offset_m, accuracy_m)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(fixes: DataFrame, late: str = "10 minutes", width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Fixes and users' largest offset by event-time window; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = fixes.withWatermark("ts", late).groupBy(window.alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("offset_m").alias("most")).select("w.start", "w.end", "user_id", "n", "most")


def sessions(fixes: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Walks of a user: fixes less than ``gap`` apart."""
    grouped = fixes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def announced_once(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key and user within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", key])

"""Streaming counterparts of the session and rate operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, timestamp: str, group: str, outcome: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Group rates by event-time window; late rows beyond the watermark are dropped on streams."""
    rows = events.withWatermark(timestamp, watermark) if events.isStreaming else events
    y = F.col(outcome).cast("long")
    out = rows.groupBy(F.window(timestamp, window).alias("w"), group).agg(F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("outcome_count"))
    return out.select(F.col("w.start").alias("window_start"), group, "row_count", "outcome_count", (F.col("outcome_count") / F.col("row_count")).alias("outcome_rate"))


def session_rates(events: DataFrame, timestamp: str, user: str, outcome: str, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    """Rows and positives of sessions that a gap of silence ends."""
    rows = events.withWatermark(timestamp, watermark) if events.isStreaming else events
    out = rows.groupBy(F.session_window(timestamp, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col(outcome).cast("long")).alias("outcome_count"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "row_count", "outcome_count")

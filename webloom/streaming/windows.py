"""Event-time windows with watermarks; each also runs as a batch, with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, at: str, late: str) -> DataFrame:
    """A watermark needs a zoned time, so a plain one is read in the session's zone; ``_bounds`` takes that back."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def _bounds(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keep)


def tumbling(events: DataFrame, size: str = "1 hour", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events and their value per window and type."""
    g = _watermarked(events, at, late).groupBy(F.window(at, size).alias("w"), "event_type")
    return _bounds(g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events and users per sliding window; users are counted exactly in a batch and to about one percent in a stream, which can't keep them all."""
    g = _watermarked(events, at, late).groupBy(F.window(at, size, step).alias("w"))
    return _bounds(g.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users") if events.isStreaming else F.countDistinct("user_id").alias("users")), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events no further apart than the gap."""
    g = _watermarked(events, at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return _bounds(g.agg(F.count("*").alias("n")), key, "n")

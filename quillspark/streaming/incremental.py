"""Streaming forms of two operators, beyond the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """ts as a timestamp with a time zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def first_events(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, length: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Events and their value by type and window."""
    g = _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")

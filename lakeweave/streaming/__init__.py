"""Windowed counts over a stream of events: the same transformation for files read once and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value by window of ts and event type; on a stream, events older than `late` are left out."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("ts", late)
    return at.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

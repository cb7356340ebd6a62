"""Beyond the operators of a route map: windows and sessions over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value by window and type; works on batches and streams, late rows are dropped after ``late``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a pause of ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")

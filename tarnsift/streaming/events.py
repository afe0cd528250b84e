"""Streams of events: an extension with no counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which takes timestamps with a zone only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; works on streams and tables."""
    events = _timed(events, late)
    n = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return n.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    events = _timed(events, late)
    n = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.col("w.start").alias("session_start"), "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])

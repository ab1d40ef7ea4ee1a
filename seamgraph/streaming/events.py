"""Event streams, beyond the batch engine: counts per event-time window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): each window once, when the watermark has passed its end. The state
    holds the open windows alone."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = held.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")

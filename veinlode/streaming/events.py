"""Extension: the event table as a stream. The source system has no streams; batch increments are in sources.files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a folder of event Parquet files."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Every event once, as long as copies come within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events and sum of values per type and tumbling window; late events within the watermark are counted."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

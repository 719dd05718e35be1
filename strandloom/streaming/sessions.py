"""Streaming extension: visits of an event stream as sessions, and counts in time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per user: runs of events no further apart than ``gap``; rows later than the watermark go."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of codes in tumbling or sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

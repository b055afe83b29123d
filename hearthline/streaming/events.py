"""Events as a stream of files: counts and means by window, late rows up to a watermark, and the
latest sighting of each listing merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Event files as they arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """kind, start, n, mean: works on a stream (rows later than `late` are left out) and on a table."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("kind"))
    return windows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("kind", F.col("window.start").alias("start"), "n", "mean")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, though it may be delivered again within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

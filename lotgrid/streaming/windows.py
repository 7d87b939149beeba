"""Extension beyond the batch pipeline: event-time windows and late data over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, value of tumbling windows; rows later than the watermark are left out.

    The same plan runs on a static frame (where watermarks do nothing) and on a stream.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events once per id while the watermark remembers them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def stream_parquet(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of parquet files as a stream, one file per trigger at most eight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)

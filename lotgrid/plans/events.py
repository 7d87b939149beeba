"""Queries of the event-time extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.session import table
from lotgrid.streaming import windows


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return windows.windowed_counts(windows.distinct_events(table(s, d, "events"))).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {"event_windows": event_windows}
ORACLE = {"event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"}

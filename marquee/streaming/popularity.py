"""Incremental popularity over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by key and window; with a watermark, so that state is dropped.
    Works on a stream and on a table."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")

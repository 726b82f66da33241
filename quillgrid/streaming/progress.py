"""Event progress as a stream: late rows wait for the watermark, windows close once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, stamp: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by kind and window; batch and streaming frames alike."""
    timed = events.withWatermark(stamp, late) if events.isStreaming else events
    found = timed.groupBy(F.window(stamp, window), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("window_start"), kind, "n", F.round("total", 2).alias("total"))

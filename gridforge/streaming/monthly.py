"""The catalogue's summary over a stream: tumbling windows, late rows dropped by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(events: DataFrame, window: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Count, sum and largest value by window and type; the same plan for a batch and a stream."""
    # a watermark needs an instant, not a local date and time
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late and events.isStreaming else events
    return source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "largest")

"""Bars of an event stream: the daily panel kept up to date, late events within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_bars(events: DataFrame, width: str = "1 day", lateness: str = "2 days", entity: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """open, high, low, close, n for each entity and window; works on streams and tables alike."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, lateness) if events.isStreaming else e
    out = e.groupBy(F.window(time, width), entity).agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count("*").alias("n")
    )
    return out.select(entity, F.col("window.start").alias("start"), "open", "high", "low", "close", "n")

"""Tumbling windows over events; the same plan for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str = "value", late: str = "10 minutes") -> DataFrame:
    """(start, keys, n, total) by window; on a stream, events later than the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")

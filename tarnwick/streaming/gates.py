"""Quality counts over a stream of events, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate_counts(events: DataFrame, time: str, value: str, low: float, high: float, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, low, ok, high) counts for each window; the same plan serves batches and streams."""
    gated = events.withWatermark(time, late) if events.isStreaming else events
    return (
        gated.groupBy(F.window(time, window))
        .agg(F.count_if(F.col(value) < low).alias("low"), F.count_if(F.col(value).between(low, high)).alias("ok"), F.count_if(F.col(value) > high).alias("high"))
        .select(F.col("window.start").alias("start"), "low", "ok", "high")
    )


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, events): runs of a user's events without a gap."""
    gated = events.withWatermark(time, late) if events.isStreaming else events
    counted = gated.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(user, F.col("s.start").alias("start"), "events")

"""Daily bars from ticks (an extension): the same aggregation, batch or streaming."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F


def daily_bars(ticks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Open, high, low and close per symbol and day of ``(user_id, ts, event_id, value)`` ticks."""
    source = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if ticks.isStreaming else ticks
    # Time, then event: one number of fixed width, so that the aggregation can hash.
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(19,0)") * F.lit(Decimal(10**19)) + F.col("event_id")
    bars = source.groupBy(F.window("ts", "1 day"), F.col("user_id").cast("string").alias("symbol")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("ticks"),
    )
    return bars.select("symbol", F.to_date("window.start").alias("day"), "open", "high", "low", "close", "ticks")

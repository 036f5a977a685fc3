"""Streaming candles: an addition for live feeds; batch operators do not depend on it.

Bars close by watermark, so a late tick within it still counts and an unclosed bar is never shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_candles(ticks: DataFrame, bar: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Closed bars of a stream of (symbol, ts timestamp, seq, price, size), in append mode."""
    order = F.struct("ts", "seq")
    df = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", bar).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size"))).alias("turnover"),
    )
    return df.select("symbol", F.unix_millis("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "turnover")

"""Daily bars of an event stream; the same transformation serves batch tables and readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """(date, ticker, low, high, mean, n) by day and event type. With lateness, a watermark on ts bounds the state of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    bars = rows.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("ticker"))
    stats = bars.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return stats.select(F.to_date("w.start").alias("date"), "ticker", "low", "high", "mean", "n")


def write_bars(events: DataFrame, path: str, checkpoint: str, lateness: str = "1 day"):
    """Append each closed day's bars of a streaming DataFrame as Parquet; returns the query."""
    return daily_bars(events, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")

"""Event-time windows over streams, and over tables just the same: an addition to the dataframe operators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(df: DataFrame, ts: str) -> Column:
    """A time column as Spark's watermarks want it."""
    return F.col(f"`{ts}`").cast("timestamp")


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: dict[str, Column], slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Aggregates by keys and windows of `width` (every `slide`, if given). watermark: how late rows of a stream may come."""
    t = df.withColumn(ts, instant(df, ts))
    if watermark and t.isStreaming:
        t = t.withWatermark(ts, watermark)
    w = F.window(F.col(f"`{ts}`"), width, slide) if slide else F.window(F.col(f"`{ts}`"), width)
    out = t.groupBy(w.alias("w"), *keys).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: dict[str, Column], watermark: str | None = None) -> DataFrame:
    """Aggregates by keys and sessions that end after a gap without rows."""
    t = df.withColumn(ts, instant(df, ts))
    if watermark and t.isStreaming:
        t = t.withWatermark(ts, watermark)
    out = t.groupBy(F.session_window(F.col(f"`{ts}`"), gap).alias("w"), *keys).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, *aggs)


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> Any:
    """Run a stream over what is there now into a table in memory, and give that table; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

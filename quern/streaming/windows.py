"""Tumbling, sliding and session windows; the reference has none of these, they are extras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late and df.isStreaming else df


def windowed(df: DataFrame, time: str, size: str, aggregates: dict[str, Column], keys: list[str] | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by (keys, window) with window_start and window_end; on a stream, rows later than ``late`` are dropped."""
    w = F.window(F.col(time).cast("timestamp"), size, slide) if not df.isStreaming else F.window(time, size, slide)
    out = _timed(df, time, late).groupBy(*(keys or []), w.alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*(keys or []), F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *aggregates)


def sessions(df: DataFrame, time: str, gap: str, aggregates: dict[str, Column], keys: list[str], late: str | None = None) -> DataFrame:
    """Aggregates by (keys, session): rows less than ``gap`` apart belong together."""
    w = F.session_window(F.col(time).cast("timestamp") if not df.isStreaming else F.col(time), gap)
    out = _timed(df, time, late).groupBy(*keys, w.alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *aggregates)

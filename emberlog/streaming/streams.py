"""Streaming forms of timelines, pairings and sessions with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeline(stream: DataFrame, time_col: str, bucket: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows for each tumbling window; windows close when the watermark passes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, bucket)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("period"), "n")


def sessions(stream: DataFrame, key: str, time_col: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    out = stream.withWatermark(time_col, late).groupBy(F.col(key), F.session_window(time_col, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def pairs(left: DataFrame, right: DataFrame, key: str, time_col: str, within: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of rows with the same key within an interval; state is dropped behind the watermarks."""
    a = left.withWatermark(time_col, late).select(F.col(key).alias("l_key"), F.col(time_col).alias("l_time"))
    b = right.withWatermark(time_col, late).select(F.col(key).alias("r_key"), F.col(time_col).alias("r_time"))
    near = (F.col("l_key") == F.col("r_key")) & (F.col("r_time") >= F.col("l_time") - F.expr(f"INTERVAL {within}")) & (F.col("r_time") <= F.col("l_time") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near)

"""Summaries of a log: overview, top values, outcomes, activity and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def filtered(df: DataFrame, filters: dict) -> DataFrame:
    """Equality filters: None is IS NULL, text and whole numbers compare as text; other kinds and unknown columns fail."""
    for name, value in filters.items():
        if name not in df.columns:
            raise ValueError(f"unknown column: {name}")
        if value is None:
            df = df.filter(F.col(name).isNull())
        elif isinstance(value, str) or (isinstance(value, int) and not isinstance(value, bool)):
            kind = dict(df.dtypes)[name]
            # a comparison in the column's own type can be pushed to the scan
            df = df.filter(F.col(name) == value) if kind == "string" and isinstance(value, str) else df.filter(F.col(name).cast("string") == str(value))
        else:
            raise ValueError(f"{name}: only text, whole numbers or None")
    return df


def bounded(n: int, most: int = 1000) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= most:
        raise ValueError(f"a whole number from 1 to {most} is needed")
    return n


def overview(df: DataFrame, time_col: str, entities: list[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("events"),
        F.unix_micros(F.min(F.col(time_col).cast("timestamp"))).alias("first_us"),
        F.unix_micros(F.max(F.col(time_col).cast("timestamp"))).alias("last_us"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in entities],
    )


def top(df: DataFrame, dim: str, n: int = 10, filters: dict | None = None) -> DataFrame:
    """Most frequent values with their share of all rows, ties by value."""
    counted = filtered(df, filters or {}).groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # the total is one row over the counts, joined by a constant instead of a window over all of them
    total = counted.agg(F.sum("n").alias("total"))
    out = counted.crossJoin(F.broadcast(total)).select("value", "n", C.percent(F.col("n"), F.col("total"), 2).alias("pct"))
    return out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(bounded(n))


def status_by(df: DataFrame, dim: str, classes: dict[str, Column], error: Column, n: int = 50) -> DataFrame:
    """Rows of each outcome class and the share of errors for each value of ``dim``."""
    out = df.groupBy(F.col(dim).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in classes.items()], C.percent(F.count_if(error), F.count(F.lit(1)), 1).alias("pct_error")
    )
    return out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(bounded(n))


def http_classes(status: Column) -> dict[str, Column]:
    """Classes of HTTP status codes by their hundreds."""
    return {f"n_{k}xx": F.floor(status / 100) == k for k in (2, 3, 4, 5)}


def activity(df: DataFrame, entity: str, distinct: list[str], time_col: str, error: Column, n: int = 20, least: int = 1) -> DataFrame:
    """Requests, distinct values, first and last time and share of errors of the busiest entities."""
    out = df.groupBy(F.col(entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct],
        F.unix_micros(F.min(F.col(time_col).cast("timestamp"))).alias("first_us"),
        F.unix_micros(F.max(F.col(time_col).cast("timestamp"))).alias("last_us"),
        C.percent(F.count_if(error), F.count(F.lit(1)), 1).alias("pct_error"),
    )
    return out.filter(F.col("n") >= least).orderBy(F.col("n").desc(), F.col("entity").asc_nulls_last()).limit(bounded(n))


def timeline(df: DataFrame, time_col: str, bucket: str, zone: str | None = None) -> DataFrame:
    """Rows for each hour, day, week or month, of local time where a zone is given."""
    if bucket not in ("hour", "day", "week", "month"):
        raise ValueError("bucket: hour, day, week or month")
    t = F.col(time_col).cast("timestamp")
    t = F.from_utc_timestamp(t, zone) if zone else t
    name = "local_period" if zone else "period"
    return df.filter(F.col(time_col).isNotNull()).groupBy(F.date_format(F.date_trunc(bucket, t), "yyyy-MM-dd HH:mm:ss").alias(name)).agg(F.count(F.lit(1)).alias("n"))


def peaks(df: DataFrame, time_col: str, bucket: str = "hour", most: int = 60) -> DataFrame:
    """The strongest periods in time order, with the peak flagged."""
    t = timeline(df, time_col, bucket).orderBy(F.col("n").desc(), "period").limit(bounded(most))
    best = t.agg(F.max("n").alias("best"))
    return t.crossJoin(F.broadcast(best)).select("period", "n", (F.col("n") == F.col("best")).alias("peak")).orderBy("period")


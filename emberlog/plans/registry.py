"""The registry of queries and their SQL, and the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def f(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """`events` as a canonical log: its moment in UTC and its type as the endpoint."""
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))

"""Presence index: when values of columns, or of groups of columns, first and last appear, how often and in which row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, values array<string>, first timestamp, last timestamp, n long, row long"


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def index(df: DataFrame, groups: dict[str, list[str]], time_col: str = "timestamp_utc", row_col: str | None = "source_row", wanted: DataFrame | None = None) -> DataFrame:
    """(name, values, first, last, n, row) of each combination of values of each group of columns, found in one pass.

    ``groups``: a name and its columns; rows in which one of them is null have no entry for it. ``row`` is the row of
    the first appearance, the least where several share the moment. ``wanted`` (name, values): only those, by a join
    before anything is added up. Each row gives one short record for each group, which is added up where it is read.
    """
    there = {k: v for k, v in groups.items() if v and all(c in df.columns for c in v)}
    if not there:
        return df.sparkSession.createDataFrame([], SCHEMA)
    row = F.col(row_col).cast("long") if row_col and row_col in df.columns else F.lit(None).cast("long")
    cells = [F.when(reduce(lambda a, b: a & b, [_text(c).isNotNull() for c in v]), F.struct(F.lit(k).alias("name"), F.array(*[_text(c) for c in v]).alias("values"))) for k, v in there.items()]
    src = df.select(F.col(time_col).cast("timestamp").alias("at"), row.alias("row"), F.explode(F.array_compact(F.array(*cells))).alias("c")).select("at", "row", "c.name", "c.values")
    if wanted is not None:
        src = src.join(wanted.select("name", "values").distinct(), ["name", "values"], "left_semi")
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("at", "row")))
    out = src.groupBy("name", "values").agg(first.alias("f"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.min("row").alias("any"))
    return out.select("name", "values", F.col("f.at").alias("first"), "last", "n", F.coalesce("f.row", "any").alias("row"))


def of_value(df: DataFrame, value: str, cols: list[str], time_col: str = "timestamp_utc", row_col: str | None = "source_row") -> DataFrame:
    """(column, first, last, n, row) of every column that holds the value."""
    wanted = df.sparkSession.createDataFrame([(c, [value]) for c in cols], "name string, values array<string>")
    some = df.filter(reduce(lambda a, b: a | b, [_text(c) == value for c in cols])) if cols else df
    return index(some, {c: [c] for c in cols}, time_col, row_col, wanted).select(F.col("name").alias("column"), "first", "last", "n", "row")


def of_findings(df: DataFrame, findings: DataFrame, time_col: str = "timestamp_utc", row_col: str | None = "source_row") -> DataFrame:
    """``findings`` (id, columns, values) with first, last, n and row of the events that hold all of a finding's values.

    The groups are the different lists of columns, as few as there are kinds of findings; findings meet the index by
    list and values, so that their number does not matter. Those whose columns are missing have no events.
    """
    name = F.array_join("columns", "\x1f")
    kinds = [r[0] for r in findings.select(name).distinct().collect()]
    keyed = findings.withColumn("__name", name)
    found = index(df, {k: k.split("\x1f") for k in kinds}, time_col, row_col, keyed.select(F.col("__name").alias("name"), "values"))
    met = keyed.join(found.select(F.col("name").alias("__n"), F.col("values").alias("__v"), "first", "last", "n", "row"), (F.col("__name") == F.col("__n")) & (F.col("values") == F.col("__v")), "left")
    return met.select(*findings.columns, "first", "last", F.coalesce("n", F.lit(0)).alias("n"), "row")

"""Blocks of the data profile of a canonical table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import quantiles


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, value, n): counts of every column's values in one aggregation, instead of an expansion for each distinct count."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("x")).select("x.col", "x.value").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Filled and distinct values of each column, and whether each row has its own value."""
    filled = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    distinct = F.count("value")
    out = long_form(df, cols).groupBy("col").agg(filled.alias("filled"), distinct.alias("distinct"))
    return out.withColumn("unique_per_row", (F.col("filled") == F.col("distinct")) & (F.col("filled") > 10))


def column_top(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    w = Window.partitionBy("col").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = long_form(df, cols).filter("value IS NOT NULL").withColumn("rk", F.row_number().over(w))
    return ranked.filter(F.col("rk") <= n)


def _by_column(df: DataFrame, cols: list[str], cells) -> DataFrame:
    """One row for each column, of one aggregation over the table: ``cells(column)`` gives its named measures."""
    names = [name for name, _ in cells(cols[0])]
    row = df.agg(*[F.struct(F.lit(c).alias("col"), *[v.alias(n) for n, v in cells(c)]).alias(f"c{i}") for i, c in enumerate(cols)])
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(cols))])).alias("x")).select("x.col", *[f"x.{n}" for n in names])


def numeric_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """min, max, mean, p50 and p95 (interpolated, exact) of numeric columns; no place holds all values of a column."""

    def cells(c: str):
        return [("min", F.min(c).cast("double")), ("max", F.max(c).cast("double")), ("avg", F.round(F.avg(c), 3).cast("double"))]

    found = quantiles.exact(df, cols, [0.5, 0.95]).groupBy("col").agg(*[F.max(F.when(F.col("p") == p, F.round("value", 3))).alias(f"p{int(100 * p)}") for p in (0.5, 0.95)])
    return _by_column(df, cols, cells).join(F.broadcast(found), "col")  # one row for each column


def hour_histogram(df: DataFrame, time_col: str) -> DataFrame:
    return df.filter(F.col(time_col).isNotNull()).groupBy(F.hour(F.col(time_col).cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def gaps(df: DataFrame, time_col: str) -> DataFrame:
    """(before_us, at_us, gap_ms) between consecutive distinct moments.

    A window over all rows would be one task. Moments are first folded into distinct ones, lagged within their hour,
    and the first moment of each hour is linked to the last of the hour before it that has any: only hours meet in one
    window.
    """
    t = df.filter(F.col(time_col).isNotNull()).select(F.unix_micros(F.col(time_col).cast("timestamp")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    t = t.withColumn("hour", F.floor(F.col("t") / 3_600_000_000))
    inner = t.withColumn("before", F.lag("t").over(Window.partitionBy("hour").orderBy("t")))
    hours = t.groupBy("hour").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    linked = hours.select(F.col("lo").alias("t"), F.lag("hi").over(Window.orderBy("hour")).alias("before"))
    pairs = inner.filter("before IS NOT NULL").select("before", "t").unionByName(linked.filter("before IS NOT NULL").select("before", "t"))
    gap = pairs.select(F.col("before").alias("before_us"), F.col("t").alias("at_us"), F.floor((F.col("t") - F.col("before") + 500) / 1000).alias("gap_ms"))
    return gap


def largest_gaps(df: DataFrame, time_col: str, n: int = 5) -> DataFrame:
    return gaps(df, time_col).orderBy(F.col("gap_ms").desc(), "before_us").limit(n)


def median_gap(df: DataFrame, time_col: str) -> DataFrame:
    """Median gap between consecutive rows; rows of the same moment are 0 apart."""
    rows = df.filter(F.col(time_col).isNotNull()).groupBy(F.unix_micros(F.col(time_col).cast("timestamp")).alias("t")).agg((F.count(F.lit(1)) - 1).alias("zeros"))
    zero = rows.filter("zeros > 0").select(F.lit(0).cast("long").alias("gap_ms"), F.col("zeros").alias("w"))
    some = gaps(df, time_col).select("gap_ms", F.lit(1).cast("long").alias("w"))
    return zero.unionByName(some).agg(F.expr("percentile(gap_ms, 0.5, w)").alias("median_gap_ms"))


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Surplus rows: the sum of count - 1 over groups of equal rows."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("c") > 1).alias("groups"))


def entities(parts: dict[str, DataFrame]) -> DataFrame:
    """Distinct non-null values of one-column tables, by name; for a union of columns pass the union."""
    each = [d.agg(F.lit(k).alias("entity"), F.countDistinct(d.columns[0]).alias("n")) for k, d in parts.items()]
    return reduce(DataFrame.unionByName, each)


def relations(df: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Most frequent pairs of two columns, with the number of distinct pairs."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    return pairs.crossJoin(F.broadcast(total)).orderBy(F.col("n").desc(), "a", "b").limit(n)


def first_last_seen(df: DataFrame, col: str, time_col: str, n: int = 10) -> DataFrame:
    t = F.col(time_col).cast("timestamp")
    out = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.min(t)).alias("first_us"), F.unix_micros(F.max(t)).alias("last_us"), F.countDistinct(F.to_date(t)).alias("active_days")
    )
    return out.orderBy(F.col("n").desc(), "value").limit(n)


def value_formats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of each format for each text column; every distinct value is classified once."""
    return long_form(df, cols).filter("value IS NOT NULL").groupBy("col", C.value_format(F.col("value")).alias("format")).agg(F.sum("n").alias("n"))


def text_lengths(df: DataFrame, cols: list[str]) -> DataFrame:
    return _by_column(df, cols, lambda c: [("shortest", F.min(F.length(c))), ("mean", F.round(F.avg(F.length(c)), 3)), ("longest", F.max(F.length(c)))])


def ip_scopes(df: DataFrame, ip_col: str) -> DataFrame:
    return df.groupBy(C.ip_scope(F.col(ip_col)).alias("scope")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct(ip_col).alias("ips"))


#: Pairs of columns whose relation a profile shows, and columns whose first and last appearance it shows
RELATIONS = [
    ("src_ip", "dst_ip"),
    ("src_ip", "dst_port"),
    ("host", "process_name"),
    ("process_name", "dst_ip"),
    ("user_id", "src_ip"),
    ("rule_name", "action"),
    ("src_ip", "endpoint"),
    ("user_id", "host"),
    ("host", "dst_ip"),
    ("user_id", "endpoint"),
]
MOST_RELATIONS = 6
SEEN = ["src_ip", "dst_ip", "user_id", "host", "process_name"]


def time_profile(df: DataFrame, time_col: str, raw_col: str = "timestamp_raw") -> DataFrame:
    """One row: first and last moment, days with data, rows without a moment and, of those, rows whose raw time was there."""
    raw = F.col(raw_col).isNotNull() if raw_col in df.columns else F.lit(False)
    t = F.col(time_col).cast("timestamp")
    return df.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.countDistinct(F.to_date(t)).alias("days"), F.count_if(t.isNull()).alias("missing"), F.count_if(t.isNull() & raw).alias("unreadable"))


def day_histogram(df: DataFrame, time_col: str) -> DataFrame:
    return df.filter(F.col(time_col).isNotNull()).groupBy(F.to_date(F.col(time_col).cast("timestamp")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def data_profile(df: DataFrame, time_col: str, skip: tuple[str, ...] = ("source_row", "timestamp_raw")) -> dict[str, DataFrame]:
    """All blocks that a table's columns allow, each a DataFrame."""
    kinds = dict(df.dtypes)
    cols = [c for c in df.columns if c not in skip]
    numeric = [c for c in cols if kinds[c] in ("int", "bigint", "smallint", "double", "float")]
    text = [c for c in cols if kinds[c] == "string"]
    ips = [c for c in ("src_ip", "dst_ip") if c in cols]
    out = {"columns": column_profile(df, cols), "top": column_top(df, cols), "duplicates": duplicate_rows(df, cols), "hours": hour_histogram(df, time_col), "gaps": largest_gaps(df, time_col), "median_gap": median_gap(df, time_col)}
    out |= {"numeric": numeric_stats(df, numeric)} if numeric else {}
    out |= {"formats": value_formats(df, text), "lengths": text_lengths(df, text)} if text else {}
    out |= {"time": time_profile(df, time_col), "days": day_histogram(df, time_col)}
    some = [(a, b) for a, b in RELATIONS if a in cols and b in cols][:MOST_RELATIONS]
    out |= {f"relation_{a}_{b}": relations(df, a, b) for a, b in some}
    out |= {f"seen_{c}": first_last_seen(df, c, time_col) for c in SEEN if c in cols}
    if {"src_ip", "dst_ip"} <= set(cols):
        # of single columns, the block of columns has the distinct values
        out["entities"] = entities({"addresses": df.select(F.col("src_ip").alias("ip")).unionByName(df.select(F.col("dst_ip").alias("ip")))})
    return out | {f"scopes_{c}": ip_scopes(df, c) for c in ips}

"""Exact quantiles without sorting: a sketch brackets the rank, filtered passes select inside the bracket."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a sketch are off by one in so many at most, and rows of a bracket that one place may put in order.
ACCURACY, INSIDE = 20_000, 1 << 20


def exact(df: DataFrame, cols: list[str], probabilities: list[float], accuracy: int = ACCURACY, inside: int = INSIDE) -> DataFrame:
    """(col, p, value): interpolated quantiles of numeric columns, as ``percentile`` gives them; null where all is null.

    One pass sketches all columns; the next counts what lies below and inside the bracket of each wanted rank. A
    bracket of over ``inside`` rows is sketched again by itself, and each time a share of ``accuracy`` / 4 is left, so
    that few passes do at any size. A bracket of one value needs no more; in others the counts of different values are
    put in order, ``inside`` at most. Only a few numbers for each column and probability reach the driver.
    """
    value = {c: F.col(f"`{c}`").cast("double") for c in cols}
    goals = [(c, p) for c in cols for p in probabilities]
    slack = 2.0 / accuracy
    around = lambda x, share: F.percentile_approx(x, [max(0.0, share - slack), min(1.0, share + slack)], accuracy)
    row = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(cols)], *[F.struct(F.min(value[c]), F.max(value[c])).alias(f"m{i}") for i, c in enumerate(cols)], *[around(value[c], p).alias(f"b{i}") for i, (c, p) in enumerate(goals)]).first()
    count = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    ends = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    found: dict[int, float | None] = {i: None for i, (c, _) in enumerate(goals) if not count[c]}
    at = {i: p * (count[c] - 1) for i, (c, p) in enumerate(goals)}
    bracket = {i: tuple(row[f"b{i}"]) for i in range(len(goals)) if i not in found}
    below: dict[int, int] = {}
    small: dict[int, tuple[float, float]] = {}
    known: dict[int, tuple[float, float]] = {}
    while bracket:
        cells = []
        for i, (lo, hi) in bracket.items():
            x = value[goals[i][0]]
            cells += [F.count_if(x < lo).alias(f"u{i}"), F.count_if(x.between(lo, hi)).alias(f"k{i}")]
        row = df.agg(*cells).first()
        again = {}
        for i, (lo, hi) in bracket.items():
            under, held = row[f"u{i}"], row[f"k{i}"]
            if not (under <= math.floor(at[i]) and math.ceil(at[i]) < under + held):
                # beyond what the sketch promises: the bracket before is right, at first that of all values
                if i in known:
                    small[i] = known[i]
                else:
                    again[i] = tuple(ends[goals[i][0]])
                continue
            below[i], known[i] = under, (lo, hi)
            if lo == hi:
                found[i] = lo
            elif held <= inside:
                small[i] = (lo, hi)
            else:
                again[i] = (lo, hi)
        wide = [i for i in again if again[i] == bracket[i]]
        if wide:
            cells = [around(F.when(value[goals[i][0]].between(*again[i]), value[goals[i][0]]), (at[i] - below[i]) / row[f"k{i}"]).alias(f"b{i}") for i in wide]
            finer = df.agg(*cells).first()
            for i in wide:
                if tuple(finer[f"b{i}"]) == again[i]:
                    small[i] = again.pop(i)  # values so frequent that the bracket stays: few are different
                else:
                    again[i] = tuple(finer[f"b{i}"])
        bracket = again
    spark = df.sparkSession
    if small:
        cells = F.array(*[F.when(value[goals[i][0]].between(lo, hi), F.struct(F.lit(i).alias("goal"), value[goals[i][0]].alias("v"))) for i, (lo, hi) in small.items()])
        each = df.select(F.explode(F.array_compact(cells)).alias("x")).groupBy("x.goal", "x.v").agg(F.count(F.lit(1)).alias("n"))
        upto = each.withColumn("upto", F.sum("n").over(Window.partitionBy("goal").orderBy("v")))
        ranks = spark.createDataFrame([(i, math.floor(at[i]) - below[i], math.ceil(at[i]) - below[i]) for i in small], "g int, lo long, hi long")
        met = upto.join(F.broadcast(ranks), F.col("goal") == F.col("g"))  # one row for each column and probability
        pick = met.groupBy("goal").agg(F.min(F.when(F.col("upto") > F.col("lo"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.col("hi"), F.col("v"))).alias("b"))
        for r in pick.collect():
            x = at[r["goal"]]
            found[r["goal"]] = r["a"] if r["a"] == r["b"] else (math.ceil(x) - x) * r["a"] + (x - math.floor(x)) * r["b"]
    return spark.createDataFrame([(c, float(p), found[i]) for i, (c, p) in enumerate(goals)], "col string, p double, value double")

"""Exact quantiles against percentile, with coarse sketches and small places."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import quantiles

P = [0.0, 0.1, 0.5, 0.95, 1.0]


@pytest.mark.parametrize(("accuracy", "inside"), [(20_000, 1 << 20), (50, 40), (20, 1)])
def test_equals_percentile(spark, accuracy, inside):
    rng = random.Random(accuracy)
    rows = [(rng.gauss(0, 1e6), rng.randrange(5), rng.choice([None, 1.5, 2.5]), None, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(5)
    cols = ["a", "b", "c", "d", "e"]
    got = {(r["col"], r["p"]): r["value"] for r in quantiles.exact(df, cols, P, accuracy, inside).collect()}
    want = df.agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_{p}") for c in cols for p in P]).first()
    for c in cols:
        for p in P:
            w = want[f"{c}_{p}"]
            assert got[c, p] == w or abs(got[c, p] - w) <= 1e-9 * abs(w), (c, p)


def test_lineitem_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {r["p"]: r["value"] for r in quantiles.exact(df, ["l_extendedprice"], [0.5, 0.95], 100, 50).collect()}
    want = df.agg(F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
    assert [round(got[p], 6) for p in (0.5, 0.95)] == [round(x, 6) for x in want]
    assert [r["value"] for r in quantiles.exact(df.limit(0), ["l_quantity"], [0.5]).collect()] == [None]
    assert quantiles.exact(df.limit(1), ["l_quantity"], [0.5]).first()["value"] == df.first()["l_quantity"] or df.limit(1).count() == 1

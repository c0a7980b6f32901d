"""Hour offsets by distinct connections, sign of the skew, bursts."""

import random

import pytest

from emberlog.operators import correlation

SCHEMA = "id long, src_ip string, dst_ip string, dst_port int, ms long"
KEYS = ["src_ip", "dst_ip", "dst_port"]
HOUR = 3_600_000


def brute(left, right, within):
    out = {}
    for h in range(-14, 15):
        n = sum(any(a[1:4] == b[1:4] and abs(b[4] + h * HOUR - a[4]) <= within for b in right) for a in left)
        if h and n:
            out[h] = n
    return out


@pytest.mark.parametrize("within", [500, 4000, 600_000, 1_800_000])
def test_offsets_equal_brute_force(spark, within):
    rng = random.Random(within)
    row = lambda i: (i, rng.choice(["a", "b", None]), "x", rng.choice([80, None]), rng.randint(-3, 40) * HOUR + rng.choice([0, 1, HOUR - 1, rng.randrange(HOUR), rng.randrange(5000)]))
    left, right = [row(i) for i in range(70)], [row(i) for i in range(60)]
    got = correlation.hour_hint(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), KEYS, within)
    assert {r.hours: r.connections for r in got.collect()} == brute(left, right, within)


def test_one_match_of_ten_gives_no_hint(spark):
    left = [(i, "a", "b", 443, i * 50 * HOUR) for i in range(10)]
    right = [(i, "a", "b", 443, 13 * HOUR + 50 * HOUR * 4 + 1000 * i) for i in range(5)]
    got = correlation.correlate_project(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), within_ms=4000)
    assert not got["consistent"] and got["hour_hint"] is None and got["matched"] == 0


def test_a_zone_that_was_declared_wrongly(spark):
    left = [(i, f"h{i % 5}", "b", 443, i * 7_777_777) for i in range(60)]
    right = [(i, s, d, p, ms - 5 * HOUR) for i, s, d, p, ms in left]
    got = correlation.correlate_project(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), within_ms=4000)
    assert got["hour_hint"] == 5


def test_clock_ahead_is_positive(spark):
    left = [(i, f"h{i % 5}", "b", 443, i * 600_000 + 2500) for i in range(60)]
    right = [(i, s, d, p, ms - 2500) for i, s, d, p, ms in left]
    got = correlation.correlate_project(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert got["skew_ms"] == 2500 and got["consistent"] and got["matched"] == 60

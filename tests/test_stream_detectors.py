"""Streaming detectors against the batch detectors, over shuffled micro-batches with late rows."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import detectors
from emberlog.streaming import detectors as streaming

SCHEMA = "src_ip string, dst_ip string, ms long, action string"
KEYS = ["src_ip", "dst_ip"]


def rows(rng):
    out = []
    for k in range(12):
        at = rng.randint(0, 10_000)
        for _ in range(40):
            at += 60_000 + (rng.randint(-900, 900) if k % 3 == 0 else rng.randint(-40_000, 90_000))
            out.append((f"a{k}", f"b{k % 4}", at, rng.choice(["ALLOW", "DENY", "DENY", "other", None])))
            if rng.random() < 0.1:
                out.append(out[-1][:3] + (rng.choice(["ALLOW", "DENY"]),))
    return out


@pytest.fixture
def shuffled(spark, tmp_path):
    """A stream of files in random order, then one row far ahead that moves the watermark over all others."""
    rng = random.Random(11)
    made = rows(rng)
    df = spark.createDataFrame(made, SCHEMA).withColumn("timestamp_utc", F.timestamp_millis("ms"))
    rng.shuffle(made)
    for i in range(6):
        part = made[i::6]
        spark.createDataFrame(part, SCHEMA).withColumn("timestamp_utc", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [("end", "end", max(m for _, _, m, _ in made) + 10 * 86_400_000, "DENY")]
    spark.createDataFrame(end, SCHEMA).withColumn("timestamp_utc", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream, tmp_path


def near(a, b):
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert all(u == v or abs(u - v) < 1e-5 for u, v in zip(x, y, strict=True)), (x, y)


def test_beacons_equal_the_batch_detector(spark, shuffled):
    df, stream, tmp = shuffled
    want = detectors.beaconing(df, KEYS, outward=F.lit(True), max_cv=0.5).select(*KEYS, "events", "mean_gap", "cv").collect()
    out = streaming.beaconing(stream, KEYS, late="2 days", max_cv=0.5)
    got = streaming.collected(out, KEYS, str(tmp / "b")).select(*KEYS, "events", "mean_gap", "cv").collect()
    near(sorted(map(tuple, got)), sorted((*r[:3], *r[3:]) for r in map(tuple, want)))


def test_pairs_equal_the_batch_detector(spark, shuffled):
    df, stream, tmp = shuffled
    want = detectors.blocked_then_allowed(df, KEYS).select(*KEYS, "pairs", "shortest").collect()
    got = streaming.collected(streaming.blocked_then_allowed(stream, KEYS, late="2 days"), KEYS, str(tmp / "p")).collect()
    near(sorted(map(tuple, got)), sorted(map(tuple, want)))


def test_idle_keys_begin_anew():
    p = streaming.Beacons(["k"], 1000)
    state = None
    for ms in (0, 100, 200):
        state = p.step(state, ms, "E")
    assert p.finding(state)[:2] == (3, 0.1)
    assert p.finding(p.step(None, 5000, "E"))[0] == 1
    q = streaming.Reopened(["k"], 1000, window=900)
    assert sorted([(5, "A"), (5, "D"), (3, "A")], key=q.order) == [(3, "A"), (5, "D"), (5, "A")]

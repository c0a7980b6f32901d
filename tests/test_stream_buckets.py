"""Streaming detectors with many keys: the state is kept by bucket, keys of any type come back whole."""

import random

from pyspark.sql import functions as F

from emberlog.operators import detectors
from emberlog.streaming import detectors as streaming

KEYS = ["user", "since", "tags"]
START = 1_700_000_000_000


def made(rng, keys=60, rows=30):
    """Rows of a few hours in order of time; the first keys are null, large and odd ones."""
    out = []
    for k in range(keys):
        user = None if k == 0 else (1 << 60) + k if k < 30 else k
        at = START + rng.randint(0, 60_000)
        for _ in range(rows):
            at += 400_000 + rng.randint(-90_000, 90_000)
            out.append((user, k % 2 and START * 1000 + 123_456, ["a\"b", None][: k % 3] if k % 3 else None, at))
    return sorted(out, key=lambda r: r[3])


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "user long, us long, tags array<string>, ms long")
    return raw.select("user", F.timestamp_micros("us").alias("since"), "tags", F.timestamp_millis("ms").alias("timestamp_utc"))


def streamed(spark, rows, tmp_path, files=6):
    """Files in order of time, a little mixed at their ends, and one row far ahead."""
    step = -(-len(rows) // files)
    parts = [rows[i : i + step] for i in range(0, len(rows), step)]
    for a, b in zip(parts, parts[1:], strict=False):
        a[-20:], b[:20] = b[:20], a[-20:]
    parts.append([(-1, None, None, rows[-1][3] + 40 * 86_400_000)])
    for i, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    return spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(found, folder):
    """The detector's last row of each key, and what the state store holds at the end."""
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r.user, r.since, tuple(r.tags) if r.tags is not None else None] = (r.events, r.mean_gap, r.cv)

    q = found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return got, q.recentProgress


def test_state_grows_with_buckets_not_with_keys(spark, tmp_path):
    rows = made(random.Random(3))
    stream = streamed(spark, list(rows), tmp_path)
    got, progress = run(streaming.beaconing(stream, KEYS, late="1 hour", max_cv=1.0, buckets=4), tmp_path / "state")
    assert len(progress) > 6 and max(p.stateOperators[0].numRowsTotal for p in progress) < 60
    batch = frame(spark, rows).withColumn("tags", F.coalesce(F.to_json("tags"), F.lit("none")))
    want = {(r.user, r.since, r.tags): (r.events, r.mean_gap, r.cv) for r in detectors.beaconing(batch, KEYS, outward=F.lit(True), max_cv=1.0).collect()}
    named = {None: "none", ('a"b',): '["a\\"b"]', ('a"b', None): '["a\\"b",null]'}
    assert len(want) == 60
    for (user, since, tags), (events, mean, cv) in got.items():
        if user != -1:
            e, m, c = want.pop((user, since, named[tags]))
            assert events == e and abs(mean - m) < 2e-3 and abs(cv - c) < 1e-5, user
    assert not want


def test_idle_keys_of_a_bucket_begin_anew(spark, tmp_path):
    rows = [(k, None, None, START + k + 1000 * n) for k in range(20) for n in range(5)]
    rows += [(k, None, None, START + k + 86_400_000 + 2000 * n) for k in range(10) for n in range(3)]
    stream = streamed(spark, sorted(rows, key=lambda r: r[3]), tmp_path, files=3)
    got, progress = run(streaming.beaconing(stream, KEYS, late="10 minutes", idle_ms=3_600_000, buckets=2), tmp_path / "state")
    assert {k: v[:2] for (k, _, _), v in got.items() if k is not None and k >= 0} == {k: (3, 2.0) if k < 10 else (5, 1.0) for k in range(20)}


def test_halves_of_the_mean_as_in_sql():
    p = streaming.Beacons(["k"], 1 << 60)
    state = None
    for ms in (0, *[146_925_356 * i + (i + 1) // 2 for i in range(1, 13)]):
        state = p.step(state, ms, "E")
    assert p.finding(state)[1] == 146_925.357

"""Registered queries of streams: the driver's events as files in a random order, read a file at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store
from ..streaming import detectors
from .catalog import SQL, error
from .registry import events, query


def _shuffled(s, d, folder: str):
    """A stream of ``events`` in files of unrelated moments; a last file moves the watermark beyond all of them."""
    e = events(s, d)
    e.repartition(4, F.xxhash64("event_id", F.lit(3))).write.parquet(f"{folder}/in")
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query("stream_beacon", f"SELECT user_id, event_type, events, mean_gap, cv FROM ({SQL['det_beacon']})")
def _(s, d):
    folder = store.scratch(s)
    found = detectors.beaconing(_shuffled(s, d, folder), ["user_id", "event_type"], "ts", late="365 days", max_gap=720_000, max_cv=0.55)
    return detectors.collected(found, ["user_id", "event_type"], folder).filter("user_id >= 0")


@query("stream_block_allow", f"SELECT user_id, pairs, shortest FROM ({SQL['det_block_allow']})")
def _(s, d):
    folder = store.scratch(s)
    found = detectors.blocked_then_allowed(_shuffled(s, d, folder), ["user_id"], "ts", error(), F.col("event_type") == "purchase", late="365 days", window=86_400, min_pairs=1)
    return detectors.collected(found, ["user_id"], folder)

"""Detectors over streams: state for each key, event-time timers that put late rows into order, expiry of idle keys."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..sources import store

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt to so many buckets, each with one state; fixed for as long as a stream goes on.
BUCKETS = 1024
#: How keys of any type are written and read back whole.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


class Ordered(StatefulProcessor):
    """Holds rows of a bucket of keys until the watermark has passed them, then takes each key's in order of time.

    Rows that come late, but before the watermark, fall into their place; later ones are dropped by Spark. A micro-batch
    asks the state store a few times for a bucket and never for a key: the rows held are one value for each slice of
    rows that came, the keys' states are one value. A subclass says how a row changes a key's state (``step``), whose
    first field is the last row's moment, and what a key's finding is (``finding``).
    """

    OUT: tuple[T.StructField, ...] = ()

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.states = handle.getValueState("states", T.StructType([T.StructField("states", T.BinaryType())]))
        self.wake = handle.getValueState("wake", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        earliest = []
        for pdf in rows:
            if len(pdf):
                part: dict[str, list[tuple[int, str]]] = {}
                for name, ms, what in zip(pdf["key"].tolist(), pdf["ms"].tolist(), pdf["what"].tolist(), strict=True):
                    part.setdefault(name, []).append((ms, what))
                self.held.appendValue((pickle.dumps(part),))
                earliest.append(int(pdf["ms"].min()))
        if earliest:
            self.wake_at(min(earliest))
        return iter(())

    def wake_at(self, ms: int) -> None:
        """Have one timer for the bucket, no later than this."""
        was = self.wake.get()[0] if self.wake.exists() else None
        if was is None or ms < was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[str, list[tuple[int, str]]] = {}
        rest: dict[str, list[tuple[int, str]]] = {}
        for (part,) in self.held.get():
            for name, rows in pickle.loads(part).items():
                for row in rows:
                    (due if row[0] <= now else rest).setdefault(name, []).append(row)
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        states = {name: s for name, s in states.items() if name in due or s[0] + self.idle_ms > now}
        found = []
        for name, rows in due.items():
            state = states.get(name)
            for ms, what in sorted(rows, key=self.order):
                if state is not None and ms - state[0] > self.idle_ms:
                    state = None  # an idle key begins anew, whether or not its timer has come
                state = self.step(state, ms, what)
            states[name] = state
            found.append((name, *self.finding(state)))
        if not rest:
            self.held.clear()
        elif due:
            self.held.put([(pickle.dumps(rest),)])
        if states:
            self.states.update((pickle.dumps(states),))
        else:
            self.states.clear()
        self.wake.clear()
        ahead = [ms for rows in rest.values() for ms, _ in rows] + [s[0] + self.idle_ms for s in states.values()]
        if ahead:
            self.wake_at(max(now + 1, min(ahead)))
        if found:
            yield pd.DataFrame(found, columns=["key", *[f.name for f in self.OUT]])

    @staticmethod
    def order(row: tuple[int, str]):
        return row

    def close(self) -> None:
        pass


class Beacons(Ordered):
    """Number, sum, sum of squares and seconds of the gaps between a key's events."""

    OUT = (T.StructField("events", T.LongType()), T.StructField("mean_gap", T.DoubleType()), T.StructField("cv", T.DoubleType()), T.StructField("flagged", T.BooleanType()))

    def __init__(self, keys, idle_ms, min_events=12, min_gap=5.0, max_gap=7200.0, max_cv=0.15):
        super().__init__(keys, idle_ms)
        self.limits = (min_events, min_gap, max_gap, max_cv)

    def step(self, state, ms, what):
        if state is None:
            return (ms, 0, 0, 0, 0.0)
        gap = ms - state[0]
        return (ms, state[1] + 1, state[2] + gap, state[3] + gap * gap, state[4] + gap / 1000)

    def finding(self, state):
        _, n, total, squares, seconds = state
        if not n:
            return (1, None, None, False)
        # seconds are added as the batch detector and its SQL do, so that halves go the same way; the spread is exact until the root
        mean = seconds / n
        cv = ((n * squares - total * total) ** 0.5 / n) / (total / n) if total else None
        least, low, high, most = self.limits
        flagged = n + 1 >= least and low <= mean <= high and cv is not None and cv <= most
        return (n + 1, math.floor(mean * 1000 + 0.5) / 1000, None if cv is None else round(cv, 6), bool(flagged))


class Reopened(Ordered):
    """Pairs of a blocked event and an allowed one right after it."""

    OUT = (T.StructField("pairs", T.LongType()), T.StructField("shortest", T.DoubleType()), T.StructField("flagged", T.BooleanType()))

    def __init__(self, keys, idle_ms, window=900.0, min_pairs=3):
        super().__init__(keys, idle_ms)
        self.window_ms, self.min_pairs = window * 1000, min_pairs

    @staticmethod
    def order(row):
        return (row[0], row[1] != "D")  # of one moment, blocked comes first

    def step(self, state, ms, what):
        last, was, pairs, shortest = state if state is not None else (ms, None, 0, None)
        if was == "D" and what == "A" and ms - last <= self.window_ms:
            pairs, shortest = pairs + 1, ms - last if shortest is None else min(shortest, ms - last)
        return (ms, what, pairs, shortest)

    def finding(self, state):
        return (state[2], None if state[3] is None else state[3] / 1000, state[2] >= self.min_pairs)


def needs_store(spark: SparkSession) -> None:
    """Set the state store where the session names none of its own."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _run(stream: DataFrame, keys: list[str], time_col: str, what: Column, late: str, processor: Ordered, buckets: int) -> DataFrame:
    needs_store(stream.sparkSession)
    store.ship(stream.sparkSession)
    marked = stream.withWatermark(time_col, late).select(F.to_json(F.struct(*keys), JSON).alias("key"), time_col, C.millis(F.col(time_col)).alias("ms"), what.alias("what"))
    src = marked.filter("what IS NOT NULL AND ms IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    out = T.StructType([T.StructField("key", T.StringType()), *processor.OUT])
    found = src.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime")
    kinds = T.StructType([T.StructField(k, stream.schema[k].dataType) for k in keys])
    return found.withColumn("key", F.from_json("key", kinds, JSON)).select("key.*", *[f.name for f in processor.OUT])


def beaconing(stream: DataFrame, keys: list[str], time_col: str = "timestamp_utc", outward: Column | None = None, late: str = "1 hour", idle_ms: int = 1 << 60, buckets: int = BUCKETS, **limits) -> DataFrame:
    """(keys, events, mean_gap, cv, flagged): each key's figures up to the watermark, whenever they change.

    The last row of a key agrees with the batch detector over all rows up to the watermark. Rows may come in any order
    within ``late``. A key is forgotten after ``idle_ms`` without an event.
    """
    outward = F.lit(True) if outward is None else outward
    return _run(stream, keys, time_col, F.when(outward, "E"), late, Beacons(keys, idle_ms, **limits), buckets)


def blocked_then_allowed(stream: DataFrame, keys: list[str], time_col: str = "timestamp_utc", deny: Column | None = None, allow: Column | None = None, late: str = "1 hour", idle_ms: int = 1 << 60, buckets: int = BUCKETS, **limits) -> DataFrame:
    """(keys, pairs, shortest, flagged): each key's pairs up to the watermark, whenever they change."""
    deny = C.is_deny(F.col("action")) if deny is None else deny
    allow = C.is_allow(F.col("action")) if allow is None else allow
    return _run(stream, keys, time_col, F.when(deny, "D").when(allow, "A"), late, Reopened(keys, idle_ms, **limits), buckets)


def collected(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a detector's stream over all that is there and give the last row of each key that is still flagged."""
    columns = stream.columns

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/found/{number:08d}")

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.option("recursiveFileLookup", True).schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(f"{folder}/found")
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), "__batch").alias("r"))
    return last.select(*keys, "r.*").filter("flagged").drop("flagged")

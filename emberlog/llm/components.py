"""Connected components of an edge table: forests within partitions, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task joins at once; a table of more is dealt to several tasks, which rounds of shuffles then join.
TOGETHER = 1 << 18


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) for the nodes of some edges, without the least ones themselves."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    root = np.array([top(i) for i in range(len(parent))], np.int64)
    child = np.flatnonzero(root != np.arange(len(root)))
    return names[child], names[root[child]]


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) as stars of what ``most`` of them, or one batch more, join."""
    held, n = [], 0

    def rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for rb in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in rb.columns])
        n += rb.num_rows
        if n > most:
            u, v = _stars(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [(u, v)], len(u)
            if 2 * n > most:
                yield rows(u, v)
                held, n = [], 0
    if n:
        yield rows(*_stars(*map(np.concatenate, zip(*held, strict=True))))
    del held
    common.release()


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least neighbour of u, u itself included.

    The least neighbour is pre-aggregated before its shuffle; the join back is an equi-join whose skewed side (a hub
    of a large component) adaptive execution can split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of an edge reaches; nodes without an edge do not appear.

    Nodes are whole numbers. Each task first replaces the edges that it has by stars, without a shuffle; so few edges
    as ``TOGETHER`` then need one task and no round. With more, each round replaces edges to larger neighbours and then
    edges to smaller ones by edges to the least neighbour (large star and small star), which keeps components whole
    and needs a number of rounds that grows with the logarithm of a component's size. What a round wrote is deleted
    after the next one, its shuffles at once. Nulls and loops are dropped; an empty table of edges gives an empty table.
    """
    common.ship(edges)
    join = partial(_joined, most=TOGETHER)
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(F.col("u") > F.col("v"))
    e, forget = common.table_of(e.mapInArrow(join, "u long, v long"))
    parts = -(-e.count() // TOGETHER)
    e, forget = _next(e.coalesce(max(1, parts)).mapInArrow(join, "u long, v long"), forget)
    mark = None
    for _ in range(most_rounds if parts > 1 else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") > F.col("v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e, forget = _next(small.filter(F.col("u") > F.col("v")).distinct(), forget)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    settled = common.checkpoint(e)
    forget()
    return settled.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(settled.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _next(df: DataFrame, forget) -> tuple[DataFrame, object]:
    """``df`` as a table of its own, and what deletes it; what it was made of goes."""
    out = common.table_of(df)
    forget()
    return out

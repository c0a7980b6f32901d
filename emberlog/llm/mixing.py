"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded whole documents."""

from __future__ import annotations

import heapq
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Most times that a document is taken, and the weights that sources get in code-point order.
MOST_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Rows of a table of rules up to which it is broadcast: some 100 bytes each.
RULES_SENT = 20_000
#: Bins of a pattern's seeded order at each of two levels; only the bin that holds the cut is ordered in full.
BINS = 1024


def word_count(text_col: str = "text"):
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Target of each source: weights repeat over the sources by code point (null last) and share the total size.

    A target stops at ``most`` times its source's size; what is above is shared anew by weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    free, left, got = set(order), Fraction(total), {}
    while free:
        each = left / sum(weight[x] for x in free)
        share = {s: each * weight[s] for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            got.update(share)
            break
        for s in over:
            got[s] = Fraction(most * sizes[s])
            left -= got[s]
        free -= over
    return {s: float(got[s]) for s in order}


class _Flow:
    """Successive shortest paths with potentials on integer capacities."""

    def __init__(self):
        self.graph: dict = defaultdict(list)

    def edge(self, a, b, cap: int, cost: int) -> list:
        one, two = [b, cap, cost, None], [a, 0, -cost, None]
        one[3], two[3] = two, one
        self.graph[a].append(one)
        self.graph[b].append(two)
        return one

    def run(self, s, t) -> int:
        moved, height = 0, defaultdict(int)
        while True:
            dist, via, heap, tick = {s: 0}, {}, [(0, 0, s)], 0
            while heap:
                d, _, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.graph[a]:
                    if e[1] > 0:
                        n = d + e[2] + height[a] - height[e[0]]
                        if n < dist.get(e[0], n + 1):
                            dist[e[0]], via[e[0]], tick = n, e, tick + 1
                            heapq.heappush(heap, (n, tick, e[0]))
            if t not in dist:
                return moved
            far = dist[t]
            for a in list(self.graph):
                height[a] += min(dist.get(a, far), far)
            path, a = [], t
            while a != s:
                path.append(via[a])
                a = via[a][3][0]
            n = min(e[1] for e in path)
            for e in path:
                e[1] -= n
                e[3][1] += n
            moved += n


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST_REPEATS) -> dict[tuple, dict]:
    """Words that each membership pattern gives to each of its sources, at the least total cost of repetition.

    ``patterns``: sorted tuple of sources -> words of the documents with that membership. A pattern can be taken
    ``most`` times over, the r-th time at cost r - 1 for each word, so that all documents are taken once before any
    is repeated where quotas allow it. A source that shares no document with another gets what its quota and size
    allow; only the others need a flow.
    """
    flow, used = _Flow(), {}
    got: dict[tuple, dict] = defaultdict(dict)
    mixed = {s for p in patterns if len(p) > 1 for s in p}
    for p, size in patterns.items():
        if mixed.isdisjoint(p):
            got[p] = {s: min(round(quotas[s]), most * size) for s in p if s in quotas}
    quotas = {s: q for s, q in quotas.items() if s in mixed}
    for p, size in patterns.items():
        if mixed.isdisjoint(p):
            continue
        for r in range(most):
            flow.edge("in", ("p", p), size, r)
        for s in p:
            used[p, s] = (flow.edge(("p", p), ("s", s), most * size, 0), most * size)
    for s, q in quotas.items():
        flow.edge(("s", s), "out", round(q), 0)
    flow.run("in", "out")
    for (p, s), (e, cap) in used.items():
        got[p][s] = cap - e[1]
    return got


def _sized(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, keep: list) -> DataFrame:
    """``keep`` with what decides a row: id, pattern, size, draw and its bins."""
    array = dict(df.dtypes)[source_col].startswith("array")
    members = F.array_sort(F.array_distinct(F.array_compact(F.col(source_col)))) if array else F.when(F.col(source_col).isNotNull(), F.array(source_col))
    members = F.when(F.size(members) > 0, members)
    # a null argument leaves the hash as it is
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    bits = BINS.bit_length() - 1
    return df.select(
        *keep,
        F.col(id_col).alias("__id"),
        members.alias("__p"),
        word_count(text_col).alias("size"),
        draw.alias("__h"),
        F.shiftrightunsigned(draw, 64 - bits).cast("int").alias("__b1"),
        F.shiftrightunsigned(draw, 64 - 2 * bits).bitwiseAND(F.lit(BINS - 1)).cast("int").alias("__b2"),
    )


def _taken(df: DataFrame, keep: list, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``keep`` with size, source_size, target and taken of each row: rules are found from sizes, then each row meets its own."""
    narrow = common.checkpoint(_sized(df, seed, id_col, text_col, source_col, []))
    patterns = {tuple(p) if p else (None,): n for p, n in narrow.groupBy("__p").agg(F.sum("size").alias("n")).collect()}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights, most)
    flows = {p: sum(v.values()) for p, v in route(patterns, goal, most).items()}
    plan = {}  # pattern -> [times all, remainder]
    for p, n in patterns.items():
        base = min(most, flows.get(p, 0) // n) if n else 0
        plan[p] = [base, flows.get(p, 0) - base * n if base < most else 0]
    spark, key = df.sparkSession, lambda p: list(p) if p != (None,) else None

    # rules are a table of the driver: up to RULES_SENT rows of it go to all tasks, a larger one is joined by pattern
    def rules(extra: dict[tuple, tuple], names: str) -> DataFrame:
        table = spark.createDataFrame([(key(p), *plan[p], *v) for p, v in extra.items()], f"p array<string>, base int, rest long{names}")
        return F.broadcast(table) if len(extra) <= RULES_SENT else table

    same = F.col("__p").eqNullSafe(F.col("p"))
    short = {p: () for p, (_, rest) in plan.items() if rest}
    first = _crossings(narrow.join(rules(short, ""), same), "__b1")
    cuts = {p: first.get(p, (BINS, 0)) for p in short}
    near = narrow.join(rules(cuts, ", cut int, before long"), same & (F.col("__b1") == F.col("cut"))).withColumn("rest", F.col("rest") - F.col("before"))
    second = _crossings(near, "__b2")
    told = {}
    for p in patterns:
        cut, before = cuts.get(p, (BINS, 0))
        cut2, inside = second.get(p, (BINS, 0))
        told[p] = (cut, cut2, before + inside, float(sum(goal[s] for s in p)), int(sum(sizes[s] for s in p)))
    rows = _sized(df, seed, id_col, text_col, source_col, keep) if keep else narrow
    joined = rows.join(rules(told, ", cut int, cut2 int, before long, target double, source_size long"), same)
    early = (F.col("__b1") < F.col("cut")) | ((F.col("__b1") == F.col("cut")) & (F.col("__b2") < F.col("cut2")))
    here = (F.col("__b1") == F.col("cut")) & (F.col("__b2") == F.col("cut2")) & (F.col("rest") > 0)
    columns = [*(c for c in rows.columns if c not in narrow.columns or c == "__id" or c == "size"), "source_size", "target"]
    clear = joined.filter(~here).select(*columns, (F.col("size") * (F.col("base") + F.when(early & (F.col("rest") > 0), 1).otherwise(0))).alias("taken"))
    order = Window.partitionBy("__p").orderBy("__h", F.col("__id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("size").over(order)
    # the document that crosses the remainder is taken where that ends nearer to it
    edge = joined.filter(here).withColumn("__take", (2 * upto - F.col("size") <= 2 * F.col("rest")).cast("int"))
    edge = edge.select(*columns, (F.col("size") * (F.col("base") + F.col("__take"))).alias("taken"))
    return clear.unionByName(edge)


def mix(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken) for each row; ``taken`` is a multiple of the row's size, up to ``most``.

    ``source_col`` is a string, or an array of strings where sources overlap: then ``source_size`` and ``target`` are
    sums over the row's sources and documents are routed by their membership pattern. A null source is one of its
    own, ordered last; nulls and repeats inside an array do not count, an empty array is the null source. Size: words
    of the whole text (null: 0). Repeated rows each count. Reruns agree.

    One row for each pattern reaches the driver, which decides them together: their number is that of the sources and
    of the ways in which they overlap, not of documents. All of a pattern's documents are taken as often as its flow
    covers them all; the remainder goes to the documents that come first by hash of seed and id (of rows without an
    id, by text as well), up to the one that crosses it (the nearer end is chosen). Ties of the hash are ordered by id,
    then size. A text of any length is counted whole; an empty table gives an empty one; of the input only id, text and
    source are read, so that other columns may have any name.
    """
    return _taken(df, [], id_col=id_col, **options).withColumnRenamed("__id", id_col)


def _crossings(rows: DataFrame, bin_col: str) -> dict[tuple, tuple[int, int]]:
    """For each pattern, the bin in whose words its first ``rest`` words end, and the words before that bin."""
    bins = rows.groupBy("__p", "rest", bin_col).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__p").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = bins.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    found = over.groupBy("__p").agg(F.min(F.struct(F.col(bin_col).alias("bin"), (F.col("upto") - F.col("n")).alias("before"))).alias("c")).collect()
    return {tuple(r["__p"]) if r["__p"] else (None,): (r["c"]["bin"], r["c"]["before"]) for r in found}


def take(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, all columns as they are; rows of size 0 are not taken.

    Each row is decided where it is, whether or not its id is null or repeated; only the rows of the bin in which a
    pattern's remainder ends move, to be put in order.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("__row")
    found = _taken(df, [row], id_col=id_col, **options).filter("taken > 0")
    times = F.expr("explode(sequence(1, CAST(taken DIV size AS INT)))")
    return found.select("__row", times.alias("__again")).select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(df.columns)])

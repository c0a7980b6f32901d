"""Correlation of sources: shared values, nearest pairs in time, clock skew, flows and range lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_values(parts: dict[str, DataFrame], least: int = 2, n: int = 20) -> DataFrame:
    """Values that several sources hold; each part has one column."""
    each = [d.filter(F.col(d.columns[0]).isNotNull()).groupBy(F.col(d.columns[0]).alias("value")).agg(F.count(F.lit(1)).alias("events")).withColumn("source", F.lit(k)) for k, d in parts.items()]
    out = reduce(DataFrame.unionByName, each).groupBy("value").agg(F.count(F.lit(1)).alias("sources"), F.sum("events").alias("events"), F.array_sort(F.collect_set("source")).alias("names"))
    return out.filter(F.col("sources") >= least).orderBy(F.col("sources").desc(), F.col("events").desc(), "value").limit(n)


def nearest_pairs(left: DataFrame, right: DataFrame, keys: list[str], within_ms: int, left_id: str = "id", right_id: str = "id", time: str = "ms") -> DataFrame:
    """(left_id, right_id, diff_ms) of the right row nearest in time to each left row, keys null-safe equal.

    ``diff_ms`` is the left row's time minus the right one's: positive where the left clock is ahead.

    Time is cut into buckets of ``within_ms``, over which a busy key spreads. In each (keys, bucket) both sides are
    sorted together, so that a left row sees the right rows just before and after it; from the buckets beside it only
    the last and the first right row can be nearest. The work is a sort, however many rows a burst has.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    cut = lambda d, i: d.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(time).alias("ms"), F.col(i).alias("id"))
    b = F.floor(F.col("ms") / within_ms).cast("long").alias("b")
    rows = cut(right, right_id).filter("ms IS NOT NULL").groupBy(*names, "ms").agg(F.min("id").alias("id")).select("*", b)
    point = F.struct("ms", "id")
    both = cut(left, left_id).filter("ms IS NOT NULL").select(*names, b, "ms", F.col("id").alias("l_id"), F.lit(None).cast(rows.select(point.alias("p")).schema["p"].dataType).alias("r"))
    both = both.unionByName(rows.select(*names, "b", "ms", F.lit(None).cast(both.schema["l_id"].dataType).alias("l_id"), point.alias("r")))
    w = Window.partitionBy(*names, "b").orderBy("ms", F.col("r").isNull())
    seen = both.withColumn("before", F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("r", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    seen = seen.filter("l_id IS NOT NULL")
    ends = rows.groupBy(*names, "b").agg(F.min(point).alias("lo"), F.max(point).alias("hi"))

    def beside(df: DataFrame, step: int, end: str) -> DataFrame:
        e = ends.select(*[F.col(n).alias(f"e{n}") for n in names], (F.col("b") - step).alias("e_b"), F.col(end).alias(f"beside_{end}"))
        on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"e{n}")) for n in names], F.col("b") == F.col("e_b"))
        return df.join(e, on, "left").drop("e_b", *[f"e{n}" for n in names])

    seen = beside(beside(seen, -1, "hi"), 1, "lo")
    near = F.transform(F.array_compact(F.array("before", "after", "beside_hi", "beside_lo")), lambda r: F.struct(F.abs(r["ms"] - F.col("ms")).alias("d"), r["ms"].alias("ms"), r["id"].alias("id")))
    best = seen.withColumn("n", F.array_min(F.filter(near, lambda r: r["d"] <= within_ms))).filter("n IS NOT NULL")
    return best.select(F.col("l_id").alias("left_id"), F.col("n.id").alias("right_id"), (F.col("ms") - F.col("n.ms")).alias("diff_ms"))


def skew_estimate(pairs: DataFrame, keys: list[str], tolerance_ms: int = 2000) -> DataFrame:
    """Median over keys of each key's median difference, and the share of keys that agree with it."""
    per = pairs.groupBy(*keys).agg(F.median("diff_ms").alias("m"))
    whole = per.agg(F.median("m").alias("skew_ms"))
    return per.crossJoin(F.broadcast(whole)).groupBy("skew_ms").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.abs(F.col("m") - F.col("skew_ms")) <= tolerance_ms).alias("agree"))


HOUR = 3_600_000


def hour_hint(left: DataFrame, right: DataFrame, keys: list[str], within_ms: int = 120_000, time: str = "ms", most: int = 14) -> DataFrame:
    """(hours, connections): left rows that have a partner where the right source is moved by that many hours.

    A right row covers the times up to ``within_ms`` from it. Within a key and an hour, covered times are merged into
    stretches by one sort, of which an hour holds few however many rows a burst has. An hour of the left then gets the
    stretches of the hours around it, each with its offset, and a row sets a bit for each offset of a stretch that
    holds it: every connection counts once for an offset, and no pair of rows is formed.
    """
    if not 0 < within_ms <= HOUR // 2:
        raise ValueError("within_ms must be half an hour at most")
    names = [f"__k{i}" for i in range(len(keys))]
    right = right.filter(F.col(time).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(time).cast("long").alias("ms")).distinct()
    reach = [F.floor((F.col("ms") + d) / HOUR).cast("long") for d in (-within_ms, within_ms)]
    part = right.withColumn("b", F.explode(F.array_distinct(F.array(*reach))))
    part = part.select(*names, "b", F.greatest(F.lit(0), F.col("ms") - within_ms - F.col("b") * HOUR).alias("lo"), F.least(F.lit(HOUR - 1), F.col("ms") + within_ms - F.col("b") * HOUR).alias("hi"))
    w = Window.partitionBy(*names, "b").orderBy("lo", "hi")
    new = (F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int")
    runs = part.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*names, "b", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # an hour has at most HOUR / (2 within_ms) + 2 stretches, and 2 * most hours have it as a neighbour
    offsets = F.array(*[F.lit(h) for h in range(-most, most + 1) if h])
    near = runs.withColumn("h", F.explode(offsets)).groupBy(*names, (F.col("b") + F.col("h")).alias("b")).agg(F.collect_list(F.struct("h", "lo", "hi")).alias("covers"))
    rows = left.filter(F.col(time).isNotNull()).select(*[F.col(k).alias(f"l{n}") for k, n in zip(keys, names, strict=True)], F.floor(F.col(time) / HOUR).cast("long").alias("lb"), F.pmod(F.col(time).cast("long"), F.lit(HOUR)).alias("at"))
    on = reduce(lambda x, y: x & y, [F.col(f"l{n}").eqNullSafe(F.col(n)) for n in names], F.col("lb") == F.col("b"))
    hit = lambda x: F.when((F.col("at") >= x["lo"]) & (F.col("at") <= x["hi"]), F.call_function("shiftleft", F.lit(1).cast("long"), (x["h"] + most).cast("int"))).otherwise(F.lit(0).cast("long"))
    bits = rows.join(near, on).select(F.aggregate("covers", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(hit(x))).alias("mask")).filter("mask != 0")
    told = bits.agg(*[F.count_if(F.getbit("mask", F.lit(h + most)) == 1).alias(f"h{h + most}") for h in range(-most, most + 1) if h])
    each = F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"h{h + most}").alias("connections")) for h in range(-most, most + 1) if h])
    return told.select(F.explode(each).alias("x")).select("x.hours", "x.connections").filter("connections > 0")


def flows(left: DataFrame, pairs: DataFrame, right: DataFrame, keys: list[str], action: str, n: int = 25) -> DataFrame:
    """Connections of each key with how many were matched, and what the other source did with them."""
    known = pairs.join(right.select(F.col("id").alias("right_id"), F.col(action).alias("__a")), "right_id").select(F.col("left_id").alias("id"), "__a")
    out = left.join(known, "id", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("connections"), F.count("__a").alias("matched"), F.array_sort(F.collect_set("__a")).alias("actions"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )
    return out.orderBy(F.col("connections").desc(), *keys).limit(n)


def range_lookup(values: DataFrame, ranges: DataFrame, value: str, lo: str = "lo", hi: str = "hi", label: str = "label", block_bits: int = 16) -> DataFrame:
    """Label of the range that holds each number, null where none does; ranges must not overlap.

    Ranges are cut at blocks of ``2^block_bits``, so that the lookup is an equality join on the block with the bounds
    as a residual; no side has to fit into memory.
    """
    r = ranges.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col(label).alias("label"), F.explode(F.sequence(F.shiftright(lo, block_bits), F.shiftright(hi, block_bits))).alias("__b"))
    v = values.withColumn("__vb", F.shiftright(value, block_bits))
    return v.join(r, (F.col("__vb") == F.col("__b")) & F.col(value).between(F.col("__lo"), F.col("__hi")), "left").select(*values.columns, "label")


def ip_hosts(df: DataFrame, ip: str = "src_ip", host: str = "host", time: str = "ms") -> DataFrame:
    """(ip, host, events, first_ms, last_ms): which host used which address, and when."""
    rows = df.filter(F.col(ip).isNotNull() & F.col(host).isNotNull()).groupBy(F.col(ip).alias("ip"), F.col(host).alias("host"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))


def attributions(connections: DataFrame, pairs: DataFrame, firewall: DataFrame, group: str = "dst_ip", process: str = "process_name", most: int = 3) -> DataFrame:
    """(value of ``group``, processes): the processes behind most of the matched firewall rows, ties by name."""
    who = pairs.join(connections.select(F.col("id").alias("left_id"), F.col(process).alias("process")), "left_id").join(firewall.select(F.col("id").alias("right_id"), group), "right_id")
    counts = who.filter("process IS NOT NULL").groupBy(group, "process").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "process")
    top = counts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "process", "n"))), lambda x: F.struct(x["process"].alias("process"), x["n"].alias("events"))).alias("processes"))


def correlate_project(connections: DataFrame, firewall: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port"), within_ms: int = 120_000, max_skew_ms: int = 120_000, tolerance_ms: int = 2000) -> dict:
    """Endpoint connections against firewall rows: skew, whether it is consistent, and matched pairs.

    Both need ``id``, ``ms`` and the keys. The skew, how far the connections' clock is ahead, is consistent if half of
    the keys or more agree within tolerance; ``matched`` pairs agree with it themselves. Otherwise ``hour_hint`` says by
    how many whole hours the firewall would have to be moved for half of the connections to have a partner.
    """
    pairs = nearest_pairs(connections, firewall, list(keys), within_ms)
    keyed = pairs.join(connections.select(F.col("id").alias("left_id"), *keys), "left_id")
    row = skew_estimate(keyed, list(keys), tolerance_ms).first()
    skew = row["skew_ms"] if row else None
    ok = bool(row and row["keys"] and 2 * row["agree"] >= row["keys"] and abs(skew) <= max_skew_ms)
    out = {"skew_ms": skew, "consistent": ok, "pairs": pairs}
    out["matched"] = pairs.filter(F.abs(F.col("diff_ms") - F.lit(skew)) <= tolerance_ms).count() if skew is not None else 0
    if not ok:
        best = hour_hint(connections, firewall, list(keys), min(within_ms, HOUR // 2)).orderBy(F.col("connections").desc(), "hours").first()
        total = connections.filter("ms IS NOT NULL").count()
        out["hour_hint"] = best["hours"] if best and 2 * best["connections"] >= total else None
    if "host" in connections.columns and "src_ip" in connections.columns:
        out["ip_hosts"] = ip_hosts(connections)
    if "process_name" in connections.columns and "dst_ip" in firewall.columns:
        out["attributions"] = attributions(connections, pairs, firewall)
    return out

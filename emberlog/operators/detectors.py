"""Detectors: robust outliers, ramps, beacons, policies, processes. Each gives one row for each finding."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from .components import connected

#: Most findings of a detector; they are ordered before they are cut, so that reruns agree.
LIMIT = 100


class Spec(NamedTuple):
    """A registered detector: the columns that it needs, what its findings' entity columns hold, techniques and role parameters.

    An entity column holds values of a canonical column, or of a role's column (``@actor``).
    """

    schemas: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    holds: dict[str, str] = {}
    mitre: tuple[str, ...] = ()
    roles: dict[str, str] = {}
    order: tuple[str, ...] = ()


REGISTRY: dict[str, Spec] = {}
SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3}


def register(name: str, schemas: str, needs: tuple[str, ...] = (), holds: dict[str, str] | None = None, mitre: tuple[str, ...] = (), roles: dict[str, str] | None = None, order: tuple[str, ...] = ()):
    """Make a detector known under ``name`` for log schemas (space-separated); ``order``: measures, largest first."""

    def f(detector):
        REGISTRY[name] = Spec(schemas, detector, needs, holds or {}, mitre, roles or {}, order)
        return detector

    return f


def scope_of(df: DataFrame, col: str) -> Column:
    """Scope of an address column; a pseudonymised copy has it in a column of its own."""
    return F.col(f"{col}_scope") if f"{col}_scope" in df.columns else C.ip_scope(F.col(col))


def base_of(df: DataFrame, col: str) -> Column:
    return F.col(f"{col}_base") if f"{col}_base" in df.columns else C.basename(F.col(col))


def flags_of(df: DataFrame, col: str) -> Column:
    return F.col(f"{col}_flags") if f"{col}_flags" in df.columns else C.command_flags(F.col(col))


def weighted_median(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row with the exact median; equal values are counted first, so that only distinct ones meet in one place."""
    return df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("w")).agg(F.expr("percentile(v, 0.5, w)").alias(name), F.sum("w").alias("actors"))


def robust(per: DataFrame, value: str, k: float, floor: float | None = None, floor_pct: float | None = None) -> DataFrame:
    """Add med, mad, scale, threshold and z. scale = max(1.4826 MAD, floor or floor_pct of the median).

    Centre and spread are one row each over one row per actor, joined by a constant.
    """
    with_med = per.crossJoin(F.broadcast(weighted_median(per, F.col(value), "med").drop("actors")))
    mad = weighted_median(with_med, F.abs(F.col(value) - F.col("med")), "mad")
    least = F.lit(float(floor)) if floor is not None else F.lit(float(floor_pct)) * F.col("med")
    out = with_med.crossJoin(F.broadcast(mad)).withColumn("scale", F.greatest(F.lit(1.4826) * F.col("mad"), least))
    return out.withColumn("threshold", F.col("med") + F.lit(float(k)) * F.col("scale")).withColumn("z", F.try_divide(F.col(value) - F.col("med"), F.col("scale")))


def severity(z: Column, k: float) -> Column:
    return F.when(z > 4 * k, "high").when(z > 2 * k, "medium").otherwise("low")


@register("resource_breadth", "web network endpoint", ("@actor", "@resource"), {"actor": "@actor"}, (), {"actor": "actor", "resource": "resource"}, ("resources",))
def resource_breadth(df: DataFrame, actor: str = "user_id", resource: str = "endpoint", k: float = 3, floor_pct: float = 0.05, min_actors: int = 5) -> DataFrame:
    per = df.filter(F.col(actor).isNotNull() & F.col(resource).isNotNull()).groupBy(F.col(actor).alias("actor")).agg(F.countDistinct(resource).alias("resources"), F.count(F.lit(1)).alias("requests"))
    out = robust(per, "resources", k, floor_pct=floor_pct).filter((F.col("actors") >= min_actors) & (F.col("resources") > F.col("threshold")))
    return out.select("actor", "resources", "requests", "med", "mad", "threshold", severity(F.col("z"), k).alias("severity"))


@register("automation_clients", "web", ("@actor", "user_agent"), {"actor": "@actor"}, (), {"actor": "actor"}, ("pct", "requests"))
def automation_clients(df: DataFrame, actor: str = "user_id", family: Column | None = None, min_pct: float = 20, baseline_ratio: float = 0.5) -> DataFrame:
    """Actors whose share of requests by automated clients is high; all are info where that is the usual case."""
    family = C.agent_family(F.col("user_agent")) if family is None else family
    per = df.filter(F.col(actor).isNotNull()).withColumn("__f", family).groupBy(F.col(actor).alias("actor")).agg(
        F.count(F.lit(1)).alias("requests"), F.count("__f").alias("automated"), F.count_if(F.col("__f") == "offensive_tool").alias("offensive"), F.array_sort(F.collect_set("__f")).alias("families")
    )
    per = per.withColumn("pct", C.percent(F.col("automated"), F.col("requests"), 1)).withColumn("flagged", F.lit(100.0) * F.col("automated") >= min_pct * F.col("requests"))
    usual = per.agg(C.ratio(F.count_if("flagged"), F.count(F.lit(1))).alias("usual"))
    out = per.filter("flagged").crossJoin(F.broadcast(usual))
    grade = F.when(F.col("usual") > baseline_ratio, "info").when(F.col("offensive") > 0, "high").when(F.col("pct") >= 50, "medium").otherwise("low")
    return out.select("actor", "requests", "automated", "pct", "families", grade.alias("severity"))


def cluster_candidates(df: DataFrame, actor: str, ip: str, k: float = 3, floor_pct: float = 0.05, max_ips: int = 20, most: int = 40, min_actors: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pairs, candidates): requests of each actor and address; actors with many requests over few addresses."""
    pairs = df.filter(F.col(actor).isNotNull() & F.col(ip).isNotNull()).groupBy(F.col(actor).alias("actor"), F.col(ip).alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("actor").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("ips")).withColumn("ratio", C.ratio(F.col("requests"), F.col("ips")))
    out = robust(per, "ratio", k, floor_pct=floor_pct).filter((F.col("actors") >= min_actors) & (F.col("ratio") > F.col("threshold")) & (F.col("ips") <= max_ips))
    return pairs, out.orderBy(F.col("ratio").desc(), "actor").limit(most).select("actor", "requests", "ips", "ratio")


@register("actor_ip_cluster", "web", ("@actor", "src_ip"), {"actors": "@actor"}, (), {"actor": "actor"})
def actor_ip_cluster(df: DataFrame, actor: str = "user_id", ip: str = "src_ip", **options) -> DataFrame:
    """Groups of candidates that share addresses; closed if no other actor uses them.

    At most 40 candidates with 20 addresses each, so their components are found on the driver.
    """
    pairs, found = cluster_candidates(df, actor, ip, **options)
    mine = pairs.join(found.select("actor"), "actor", "left_semi")
    outside = pairs.join(mine.select("ip").distinct(), "ip", "left_semi").join(found.select("actor"), "actor", "left_anti")
    links = mine.select("actor", "ip").collect()
    open_ips = {r["ip"] for r in outside.select("ip").distinct().collect()}
    rows = []
    for n, (actors, ips) in enumerate(connected([(r["actor"], r["ip"]) for r in links]), 1):
        closed = not set(ips) & open_ips
        rows.append((f"C{n}", [str(a) for a in actors], [str(i) for i in ips], closed, "high" if closed and len(actors) >= 2 else "medium"))
    return df.sparkSession.createDataFrame(rows, "cluster string, actors array<string>, ips array<string>, closed boolean, severity string")


@register("activity_ramp", "web network endpoint", ("@actor", "timestamp_utc"), {"actor": "@actor"}, (), {"actor": "actor"}, ("lr",))
def activity_ramp(df: DataFrame, actor: str = "user_id", time_col: str = "timestamp_utc", k: float = 3, floor: float = 0.2, min_total: int = 100, min_ratio: float = 3, min_final: int = 50, min_days: int = 3, min_actors: int = 5) -> DataFrame:
    """Actors whose activity grows from the first to the last third of the time range."""
    t = df.filter(F.col(actor).isNotNull() & F.col(time_col).isNotNull()).select(F.col(actor).alias("actor"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"))
    bounds = t.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    third = (F.col("t1") - F.col("t0")) / 3
    per = t.crossJoin(F.broadcast(bounds)).groupBy("actor").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("t") < F.col("t0") + third).alias("first"),
        F.count_if((F.col("t") >= F.col("t0") + third) & (F.col("t") < F.col("t0") + 2 * third)).alias("middle"),
        F.count_if(F.col("t") >= F.col("t0") + 2 * third).alias("last"),
        F.max(F.datediff(F.timestamp_micros("t1"), F.timestamp_micros("t0"))).alias("days"),
    )
    per = per.filter((F.col("total") >= min_total) & (F.col("days") >= min_days)).withColumn("lr", F.ln((F.col("last") + 1) / (F.col("first") + 1)))
    out = robust(per, "lr", k, floor=floor).filter((F.col("actors") >= min_actors) & (F.col("lr") > F.col("threshold")) & ((F.col("last") + 1) / (F.col("first") + 1) >= min_ratio) & (F.col("last") >= min_final))
    return out.select("actor", "total", "first", "middle", "last", "lr", severity(F.col("z"), k).alias("severity"))


@register("service_fanout", "network", ("src_ip", "dst_ip"), {"actor": "src_ip"}, ("T1046",), {}, ("services",))
def service_fanout(df: DataFrame, actor: str = "src_ip", service: Column | None = None, k: float = 3, floor_pct: float = 0.05, min_services: int = 10, min_actors: int = 5, denied: Column | None = None) -> DataFrame:
    """Actors that reach far more services than others, with the share of their events that was denied."""
    if service is None:
        df = df.filter("dst_ip IS NOT NULL")
        service = F.concat(F.col("dst_ip"), F.lit(":"), F.coalesce(F.col("dst_port").cast("string"), F.lit("-")))
    if denied is None and "action" in df.columns:
        denied = C.is_deny(F.col("action"))
    share = F.lit(None).cast("double") if denied is None else C.percent(F.count_if(denied), F.count(F.lit(1)), 1)
    per = df.filter(F.col(actor).isNotNull()).withColumn("__s", service).groupBy(F.col(actor).alias("actor")).agg(F.countDistinct("__s").alias("services"), F.count(F.lit(1)).alias("events"), share.alias("pct_denied"))
    out = robust(per, "services", k, floor_pct=floor_pct).filter((F.col("actors") >= min_actors) & (F.col("services") > F.col("threshold")) & (F.col("services") >= min_services))
    return out.select("actor", "services", "events", "pct_denied", "med", "mad", severity(F.col("z"), k).alias("severity"))


@register("policy_contradiction", "network", ("rule_name", "action", "src_ip"), {"rule": "rule_name"}, (), {}, ("allowed",))
def policy_contradiction(df: DataFrame, rule: str = "rule_name", source: str = "src_ip", blocking: Column | None = None, allow: Column | None = None, min_events: int = 3, most: int = 10) -> DataFrame:
    """Blocking rules that let events pass, with the sources of most of them."""
    blocking = F.col(rule).rlike(V.BLOCKING_RULE) if blocking is None else blocking
    allow = C.is_allow(F.col("action")) if allow is None else allow
    rows = df.filter(blocking).select(F.col(rule).alias("rule"), F.col(source).alias("src"), allow.alias("allow"))
    totals = rows.groupBy("rule").agg(F.count(F.lit(1)).alias("events"), F.count_if("allow").alias("allowed")).filter(F.col("allowed") >= min_events)
    by = rows.filter("allow").groupBy("rule", "src").agg(F.count(F.lit(1)).alias("n"))
    ranked = by.withColumn("rk", F.row_number().over(Window.partitionBy("rule").orderBy(F.col("n").desc(), F.col("src").asc_nulls_last()))).filter(F.col("rk") <= most)
    tops = ranked.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "src"))), lambda x: x["src"]).alias("sources"))
    share = C.ratio(F.col("allowed"), F.col("events"))
    return totals.join(tops, "rule", "left").select("rule", "events", "allowed", "sources", F.when(share >= 0.5, "high").when(share >= 0.1, "medium").otherwise("low").alias("severity"))


@register("risky_outbound", "network", ("src_ip", "dst_ip", "dst_port", "action"), {"actor": "src_ip"}, ("T1021",), {}, ("events",))
def risky_outbound(df: DataFrame, actor: str = "src_ip", target: str = "dst_ip", port: str = "dst_port", risky: Column | None = None, min_events: int = 3) -> DataFrame:
    """Allowed connections from private to public addresses on administration ports."""
    if risky is None:
        risky = C.is_allow(F.col("action")) & (scope_of(df, "src_ip") == "private") & (scope_of(df, "dst_ip") == "public") & F.col("dst_port").isin(V.RISKY_PORTS)
    out = df.filter(risky).groupBy(F.col(actor).alias("actor")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct(target).alias("targets"), F.array_sort(F.collect_set(port)).alias("ports")).filter(F.col("events") >= min_events)
    return out.withColumn("severity", F.when((F.col("events") >= 50) | (F.col("targets") >= 5), "high").when(F.col("events") >= 10, "medium").otherwise("low"))


@register("volume_outlier", "network", ("src_ip", "dst_ip", "bytes_out"), {"actor": "src_ip"}, ("T1048",), {}, ("size",))
def volume_outlier(df: DataFrame, actor: str = "src_ip", target: str = "dst_ip", size: Column | None = None, outward: Column | None = None, k: float = 3, floor: float = 0.7, min_size: float = 1_000_000, min_actors: int = 5) -> DataFrame:
    """Actors that send out far more than others, with their main destination."""
    size = F.col("bytes_out") if size is None else size
    outward = (scope_of(df, "dst_ip") == "public") if outward is None else outward
    by = df.filter(F.col(actor).isNotNull() & outward & size.isNotNull()).groupBy(F.col(actor).alias("actor"), F.col(target).alias("target")).agg(F.sum(size).alias("b"))
    w = Window.partitionBy("actor").orderBy(F.col("b").desc(), F.col("target").asc_nulls_last())
    first = by.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("actor", F.col("target").alias("main_target"))
    per = by.groupBy("actor").agg(F.sum("b").alias("size")).withColumn("lb", F.ln(1 + F.col("size")))
    out = robust(per, "lb", k, floor=floor).filter((F.col("actors") >= min_actors) & (F.col("lb") > F.col("threshold")) & (F.col("size") >= min_size))
    return out.join(first, "actor").select("actor", "size", "main_target", severity(F.col("z"), k).alias("severity"))


@register("beaconing", "network endpoint", ("src_ip", "dst_ip", "dst_port", "timestamp_utc"), {"src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port"}, ("T1071",), {}, ("events",))
def beaconing(df: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port"), time_col: str = "timestamp_utc", outward: Column | None = None, min_events: int = 12, min_gap: float = 5, max_gap: float = 7200, max_cv: float = 0.15) -> DataFrame:
    """Keys whose events are evenly spaced: the spread of gaps is small against their mean."""
    outward = (scope_of(df, "dst_ip") == "public") if outward is None else outward
    t = df.filter(outward & F.col(time_col).isNotNull()).select(*keys, C.millis(F.col(time_col)).alias("ms"))
    gap = t.withColumn("gap", (F.col("ms") - F.lag("ms").over(Window.partitionBy(*keys).orderBy("ms"))) / 1000.0).filter("gap IS NOT NULL")
    per = gap.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("events"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"))
    out = per.filter((F.col("events") >= min_events) & F.col("mean_gap").between(min_gap, max_gap)).withColumn("cv", F.try_divide("sd_gap", "mean_gap")).filter(F.col("cv") <= max_cv)
    return out.select(*keys, "events", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 6).alias("cv"), F.when((F.col("cv") <= 0.05) & (F.col("events") >= 50), "high").otherwise("medium").alias("severity"))


@register("blocked_then_allowed", "network", ("src_ip", "dst_ip", "dst_port", "action", "timestamp_utc"), {"src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port"}, (), {}, ("pairs",))
def blocked_then_allowed(df: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port"), time_col: str = "timestamp_utc", deny: Column | None = None, allow: Column | None = None, window: float = 900, min_pairs: int = 3) -> DataFrame:
    """Keys that are allowed soon after they were blocked."""
    deny = C.is_deny(F.col("action")) if deny is None else deny
    allow = C.is_allow(F.col("action")) if allow is None else allow
    t = df.select(*keys, C.millis(F.col(time_col)).alias("ms"), F.when(deny, "D").when(allow, "A").alias("what")).filter("what IS NOT NULL AND ms IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy("ms", F.col("what").desc())
    pairs = t.withColumn("was", F.lag("what").over(w)).withColumn("gap", (F.col("ms") - F.lag("ms").over(w)) / 1000.0)
    out = pairs.filter((F.col("was") == "D") & (F.col("what") == "A") & (F.col("gap") <= window)).groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.min("gap").alias("shortest")).filter(F.col("pairs") >= min_pairs)
    return out.withColumn("severity", F.when(F.col("pairs") >= 10, "high").when(F.col("pairs") >= 5, "medium").otherwise("low"))


@register("lolbin_network", "endpoint", ("host", "process_name", "dst_ip"), {"host": "host", "process": ""}, ("T1218", "T1071"), {}, ("events",))
def lolbin_network(df: DataFrame, min_events: int = 1) -> DataFrame:
    process = base_of(df, "process_name")
    rows = df.filter(process.isin(V.LOLBINS) & (scope_of(df, "dst_ip") == "public"))
    out = rows.groupBy("host", process.alias("process")).agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set("dst_ip")).alias("targets")).filter(F.col("events") >= min_events)
    return out.withColumn("severity", F.when(F.col("events") >= 10, "high").otherwise("medium"))


@register("suspicious_parent", "endpoint", ("host", "process_name", "parent_process"), {"host": "host", "parent": "", "process": ""}, ("T1204.002", "T1059"), {}, ("events",))
def suspicious_parent(df: DataFrame) -> DataFrame:
    parent, child = base_of(df, "parent_process"), base_of(df, "process_name")
    out = df.filter(parent.isin(V.OFFICE) & child.isin(V.SHELLS)).groupBy("host", parent.alias("parent"), child.alias("process")).agg(F.count(F.lit(1)).alias("events"))
    return out.withColumn("severity", F.lit("high"))


@register("suspicious_cmdline", "endpoint", ("host", "process_name", "command_line"), {"host": "host", "process": "", "flags": ""}, ("T1059.001", "T1027"), {}, ("events",))
def suspicious_cmdline(df: DataFrame) -> DataFrame:
    rows = df.select("host", base_of(df, "process_name").alias("process"), flags_of(df, "command_line").alias("flags")).filter("flags IS NOT NULL")
    out = rows.groupBy("host", "process", "flags").agg(F.count(F.lit(1)).alias("events"))
    return out.withColumn("severity", F.when(F.col("flags").rlike("encoded|download|script_proxy"), "high").otherwise("medium"))


def correlate(findings: DataFrame, min_severity: str = "medium") -> DataFrame:
    """Entities that several detectors name: (entity, signals, detectors, severity); two or more make it high."""
    grade = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    f = findings.withColumn("g", grade[F.col("severity")]).filter(F.col("g") >= SEVERITY[min_severity])
    out = f.groupBy("entity").agg(F.countDistinct("detector").alias("signals"), F.array_sort(F.collect_set("detector")).alias("detectors"), F.max("g").alias("g"))
    names = F.array(*[F.lit(k) for k in SEVERITY])
    out = out.withColumn("severity", F.when(F.col("signals") >= 2, "high").otherwise(F.element_at(names, F.col("g") + 1)))
    return out.select("entity", "signals", "detectors", "severity")


ROLES = ("actor", "resource")


class RoleError(ValueError):
    """A role names a column that does not exist or holds nothing."""


def columns_with_data(df: DataFrame, cols: list[str] | None = None) -> set[str]:
    """The columns that hold a value in some row, found in one aggregation."""
    cols = [c for c in (cols or df.columns) if c in df.columns]
    if not cols:
        return set()
    row = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return {c for i, c in enumerate(cols) if row[i]}


def resolve_roles(df: DataFrame, overrides: dict[str, str] | None = None, declared: dict[str, str] | None = None) -> dict[str, str]:
    """The columns of actor and resource: overrides, else what the mapping declares, else inferred.

    Inferred: the actor is ``user_id`` where that holds data, else ``src_ip``; the resource is the derived column (``x_``)
    with the most distinct values, two at least and ties by name, else ``endpoint``.
    """
    filled = columns_with_data(df)
    chosen = {**{k: v for k, v in (declared or {}).items() if v}, **{k: v for k, v in (overrides or {}).items() if v}}
    for role, col in chosen.items():
        if role not in ROLES:
            raise RoleError(f"unknown role {role}")
        if col not in filled:
            raise RoleError(f"{role}: column {col} {'holds nothing' if col in df.columns else 'does not exist'}")
    chosen.setdefault("actor", "user_id" if "user_id" in filled else "src_ip")
    if "resource" not in chosen:
        derived = sorted(c for c in filled if c.startswith("x_"))
        counts = df.agg(*[F.countDistinct(f"`{c}`").alias(c) for c in derived]).first().asDict() if derived else {}
        many = {c: n for c, n in counts.items() if n >= 2}
        chosen["resource"] = min(many, key=lambda c: (-many[c], c), default="endpoint")
    return chosen


def missing_columns(df: DataFrame, needs: list[str], filled: set[str] | None = None) -> str | None:
    """Why a detector does not apply: columns that do not exist or hold nothing; None if all is there."""
    if gone := [c for c in needs if c not in df.columns]:
        return f"missing columns {gone}"
    filled = columns_with_data(df, needs) if filled is None else filled
    if empty := [c for c in needs if c not in filled]:
        return f"columns without data {empty}"
    return None


def ensure_columns(df: DataFrame, cols: list[str]) -> bool:
    """Whether all columns exist and hold data; otherwise a detector does not apply."""
    return missing_columns(df, cols) is None


def ordered(name: str, found: DataFrame, most: int = LIMIT) -> DataFrame:
    """A detector's strongest findings in a total order: by its measures, then by entity."""
    spec = REGISTRY[name]
    keys = [F.col(c).desc_nulls_last() for c in spec.order if c in found.columns]
    keys += [F.col(c).cast("string").asc_nulls_last() for c in found.columns if c not in spec.order]
    return found.orderBy(*keys).limit(most)


def run_all(df: DataFrame, schema: str, roles: dict[str, str] | None = None, names: list[str] | None = None, most: int = LIMIT, **options) -> dict[str, DataFrame | str]:
    """Every detector for a log schema: its findings in order, at most ``most``, or why it does not apply.

    ``roles`` (of ``resolve_roles``, which is called if not given) name the actor and the resource; ``options`` of a
    detector go first. ``names``: only those, whatever their schema. A failure stays its own.
    """
    picked = {n: s for n, s in REGISTRY.items() if (n in names if names else schema in s.schemas.split())}
    roles = resolve_roles(df) if roles is None else roles
    needs = {n: [roles[c[1:]] if c[0] == "@" else c for c in s.needs] for n, s in picked.items()}
    filled = columns_with_data(df, sorted({c for v in needs.values() for c in v}))
    out: dict[str, DataFrame | str] = {}
    for name, spec in picked.items():
        why = missing_columns(df, needs[name], filled)
        if name == "actor_ip_cluster" and roles["actor"] == "src_ip":
            why = "the actor is the address itself"
        if why:
            out[name] = f"not applicable: {why}"
            continue
        try:
            found = spec.run(df, **({p: roles[r] for p, r in spec.roles.items()} | options.get(name, {})))
            out[name] = ordered(name, found, most)
        except Exception as e:  # noqa: BLE001  one detector must not stop the others
            out[name] = f"failed: {type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return out

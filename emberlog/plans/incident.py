"""An incident over several cases: skew-corrected timeline, shared values and Markdown report."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation, detectors, presence
from ..sources import store


#: Rows of a correlation's tables that its ledger entry shows.
SHOWN = 100


def timeline(cases: dict[str, DataFrame], skew_ms: dict[str, int] | None = None, n: int = 400) -> DataFrame:
    """First ``n`` events of all cases in corrected time order; each case needs ``timestamp_utc`` and ``source_row``."""
    parts = []
    for name, df in cases.items():
        off = (skew_ms or {}).get(name, 0)
        what = F.coalesce(*[F.col(c).cast("string") for c in ("endpoint", "rule_name", "process_name", "action") if c in df.columns], F.lit(""))
        parts.append(df.filter("timestamp_utc IS NOT NULL").select(F.lit(name).alias("case"), F.timestamp_micros(F.unix_micros("timestamp_utc") - off * 1000).alias("at"), "source_row", what.alias("what")))
    return reduce(DataFrame.unionByName, parts).orderBy("at", "case", "source_row").limit(n)


def findings_timeline(cases: dict[str, tuple[DataFrame, DataFrame]], skew_ms: dict[str, int] | None = None, n: int = 400) -> DataFrame:
    """(at, case, kind, detector, severity, entity, events, row, corrected): first ``n`` moments at which findings begin and end.

    ``cases``: name -> (events, findings), findings as (id, detector, severity, columns, values). Each case's presence
    index answers for all its findings at once. Times of a case with a skew, by which its clock is ahead, are put
    right. A finding whose events all share one moment has no end.
    """
    parts = []
    for name, (df, found) in cases.items():
        off = (skew_ms or {}).get(name)
        seen = presence.of_findings(df, found).filter("first IS NOT NULL")
        right = lambda c, off=off: F.timestamp_micros(F.unix_micros(c) - (off or 0) * 1000)
        ends = F.array(F.struct(right(F.col("first")).alias("at"), F.lit("begins").alias("kind")), F.when(F.col("last") != F.col("first"), F.struct(right(F.col("last")).alias("at"), F.lit("ends").alias("kind"))))
        entity = F.array_join(F.transform(F.arrays_zip("columns", "values"), lambda x: F.concat_ws("=", x["columns"], x["values"])), ", ")
        parts.append(seen.select(F.explode(F.array_compact(ends)).alias("e"), "detector", "severity", entity.alias("entity"), F.col("n").alias("events"), "row").select("e.at", F.lit(name).alias("case"), "e.kind", "detector", "severity", "entity", "events", "row", F.lit(off is not None).alias("corrected")))
    return reduce(DataFrame.unionByName, parts).orderBy("at", "case", "kind", "detector", "entity").limit(n)


def findings_of(case) -> DataFrame:
    """(id, detector, severity, columns, values) of a case's ledger; a group counts for each of its members.

    Findings are bounded by each detector's limit. Entity columns that are none of the log are left out.
    """
    entries = case.ledger.entries()
    roles = next((e["data"] for e in reversed(entries) if e["type"] == "roles"), {})
    rows = []
    for d in (e["data"] for e in entries if e["type"] == "finding"):
        holds = detectors.REGISTRY[d["detector"]].holds
        named = {roles.get(h[1:], h) if h[:1] == "@" else h: d["entity"].get(c) for c, h in holds.items() if h}
        cells = [[(c, str(x)) for x in (v if isinstance(v, list) else [v]) if x is not None] for c, v in named.items()]
        for combination in product(*[c for c in cells if c]):
            if combination:
                rows.append((str(d["id"]), d["detector"], d["severity"], [c for c, _ in combination], [v for _, v in combination]))
    return case.spark.createDataFrame(rows, "id string, detector string, severity string, columns array<string>, values array<string>")


def shared(cases: dict[str, DataFrame], col: str) -> DataFrame:
    return correlation.shared_values({k: d.select(col) for k, d in cases.items() if col in d.columns})


def correlate_cases(endpoint, firewall) -> dict:
    """Correlate an endpoint case with a firewall case and record the result, by its hash, in both ledgers."""
    cut = lambda d, *c: d.select(F.col("source_row").alias("id"), "src_ip", "dst_ip", "dst_port", F.unix_millis("timestamp_utc").alias("ms"), *[x for x in c if x in d.columns])
    left = cut(endpoint.table().filter("dst_ip IS NOT NULL"), "host", "process_name")
    found = correlation.correlate_project(left, cut(firewall.table()))
    rows = {}
    for k in ("ip_hosts", "attributions"):
        if k in found:
            # whole tables beside the endpoint's case; the entry shows the first rows and says so
            path = f"{endpoint.folder}/correlation/{k}"
            found[k].write.mode("overwrite").parquet(path)
            whole = endpoint.spark.read.schema(found[k].schema).parquet(path)
            some = whole.orderBy(*[F.col(c).cast("string") for c in whole.columns if c != "processes"]).limit(SHOWN + 1).collect()
            rows[k] = {"rows": [r.asDict(recursive=True) for r in some[:SHOWN]], "more": len(some) > SHOWN, "table": path}
    facts = {"skew_ms": found["skew_ms"], "consistent": found["consistent"], "hour_hint": found.get("hour_hint"), "paired": found["pairs"].count(), "matched": found["matched"], "skewed": endpoint.folder, **rows}
    text = json.dumps(facts, sort_keys=True, default=str)
    for case in (endpoint, firewall):
        store.write_text(case.spark, f"{case.folder}/correlation.json", text)
        case.ledger.append("correlation", {"sha256": hashlib.sha256(text.encode()).hexdigest(), "candidates": [], **facts})
    return facts


def report(title: str, events: DataFrame, values: DataFrame) -> str:
    out = [f"# {title}", "", "## Timeline", ""]
    out += [f"* {r['at']} {r['case']} #{r['source_row']} {r['what']}" for r in events.collect()]
    out += ["", "## Shared values", ""]
    out += [f"* {r['value']}: {', '.join(r['names'])} ({r['events']} events)" for r in values.collect()]
    return "\n".join(out) + "\n"

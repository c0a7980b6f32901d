"""Registered queries of presence: first and last appearances, findings on a common clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import presence, quantiles
from . import incident, questions
from .registry import events, query, t

_E = "WITH e AS (SELECT event_id AS r, user_id, event_type, props, ts, epoch_us(ts) AS us FROM events)"
_ONE = "SELECT '{n}' AS name, {v} AS vals, min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_min(r, (us, r)) AS \"row\" FROM e GROUP BY ALL"


@query("presence_index", f"{_E}, p AS ({_ONE.format(n='user', v='user_id::VARCHAR')} UNION ALL {_ONE.format(n='type', v='event_type')} UNION ALL {_ONE.format(n='both', v="user_id || '|' || event_type")} UNION ALL {_ONE.format(n='props', v='props')}) SELECT * FROM p")
def _(s, d):
    found = presence.index(events(s, d), {"user": ["user_id"], "type": ["event_type"], "both": ["user_id", "event_type"], "props": ["props"]}, "ts", "event_id")
    return found.select("name", F.array_join("values", "|").alias("vals"), F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n", "row")


_CASES = f"""{_E}, c AS (SELECT *, CASE r % 2 WHEN 0 THEN 'a' ELSE 'b' END AS c FROM e),
f AS (SELECT c, 'busy' AS detector, 'high' AS severity, 'user_id=' || user_id AS entity, min(us) AS lo, max(us) AS hi, count(*) AS events, arg_min(r, (us, r)) AS "row" FROM c GROUP BY ALL HAVING count(*) >= 38
  UNION ALL SELECT c, 'pair', 'low', 'user_id=' || user_id || ', event_type=' || event_type, min(us), max(us), count(*), arg_min(r, (us, r)) FROM c WHERE event_type IN ('error', 'signup') GROUP BY ALL HAVING count(*) >= 12),
t AS (SELECT c AS "case", CASE k WHEN 0 THEN lo ELSE hi END - CASE c WHEN 'a' THEN 2500000 ELSE 0 END AS at_us, CASE k WHEN 0 THEN 'begins' ELSE 'ends' END AS kind, detector, severity, entity, events, "row", c = 'a' AS corrected FROM f CROSS JOIN (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR hi <> lo)
SELECT * FROM t ORDER BY at_us, "case", kind, detector, entity LIMIT 400"""


@query("findings_timeline", _CASES)
def _(s, d):
    e = events(s, d).withColumn("timestamp_utc", F.col("ts")).withColumn("source_row", F.col("event_id"))
    cases = {}
    for name, rest in (("a", 0), ("b", 1)):
        df = e.filter(F.col("event_id") % 2 == rest)
        busy = df.groupBy("user_id").count().filter("count >= 38").select(F.lit("1").alias("id"), F.lit("busy").alias("detector"), F.lit("high").alias("severity"), F.array(F.lit("user_id")).alias("columns"), F.array(F.col("user_id").cast("string")).alias("values"))
        pair = df.filter("event_type IN ('error', 'signup')").groupBy("user_id", "event_type").count().filter("count >= 12")
        pair = pair.select(F.lit("2").alias("id"), F.lit("pair").alias("detector"), F.lit("low").alias("severity"), F.array(F.lit("user_id"), F.lit("event_type")).alias("columns"), F.array(F.col("user_id").cast("string"), F.col("event_type")).alias("values"))
        cases[name] = (df, busy.unionByName(pair))
    out = incident.findings_timeline(cases, {"a": 2500})
    return out.select("case", F.unix_micros("at").alias("at_us"), "kind", "detector", "severity", "entity", "events", "row", "corrected")


@query("question_value_seen", f"{_E} SELECT 'event_type' AS \"column\", min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_min(r, (us, r)) AS \"row\" FROM e WHERE event_type = 'purchase'")
def _(s, d):
    e = events(s, d).select(F.col("ts").alias("timestamp_utc"), F.col("event_id").alias("source_row"), F.col("user_id").cast("string").alias("user_id"), "event_type", "props")
    kind, found = questions.answer("When was 'purchase' first seen?", e)
    assert kind == "value_seen"
    return found.select("column", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n", "row")


@query("question_who_talks", "SELECT user_id::VARCHAR AS a, event_type AS b, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS pairs FROM events GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 10")
def _(s, d):
    e = events(s, d).select(F.col("ts").alias("timestamp_utc"), F.col("user_id").cast("string").alias("src_ip"), F.col("event_type").alias("dst_ip"))
    return questions.answer("who talks to whom", e)[1]


_P = (0.01, 0.25, 0.5, 0.95, 0.999)
_COLS = ("l_extendedprice", "l_quantity", "l_partkey")


@query("exact_quantiles", " UNION ALL ".join(f"SELECT '{c}' AS col, {p}::DOUBLE AS p, round(quantile_cont({c}::DOUBLE, {p}), 4) AS value FROM lineitem" for c in _COLS for p in _P))
def _(s, d):
    return quantiles.exact(t(s, d, "lineitem"), list(_COLS), list(_P)).withColumn("value", F.round("value", 4))

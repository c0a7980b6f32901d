"""Registered queries of sources: files written from the driver's tables and read again as logs are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import networks
from ..sources import csv_records, store
from .registry import query, t


# A file is written with every field quoted, so that line ends, marks and delimiters of the texts are inside quotes.
@query("csv_quoted_records", "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS chars, source FROM documents")
def _(s, d):
    path = store.scratch(s)
    docs = t(s, d, "documents").select("doc_id", "text", "source")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    back = csv_records.read(s, path)
    text = F.coalesce("text", F.lit(""))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("long").alias("chars"), F.nullif("source", F.lit("")).alias("source"))


@query("csv_record_places", "SELECT count(*) AS records, count(DISTINCT doc_id) AS ids, true AS dense FROM documents")
def _(s, d):
    """The records of a file are numbered without gaps: their numbers sum up to that of a whole range."""
    path = store.scratch(s)
    t(s, d, "documents").select("doc_id", "text").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    each = csv_records.read(s, path).groupBy("__file").agg(F.count(F.lit(1)).alias("n"), F.min("__number").alias("lo"), F.max("__number").alias("hi"), F.countDistinct("__number").alias("u"), F.countDistinct("doc_id").alias("ids"))
    return each.agg(F.sum("n").alias("records"), F.sum("ids").alias("ids"), F.bool_and((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("u") == F.col("n"))).alias("dense"))


# 4: networks of mixed lengths over numbers spread by a multiplier; 6: networks below 2001:db8::/32
_NETS = """WITH net AS (SELECT 's' || s_suppkey AS label, 4 + s_suppkey % 21 AS len, (s_suppkey * 2654435761 % 4294967296) AS base FROM supplier),
six AS (SELECT 'x' || s_suppkey AS label, 33 + s_suppkey % 14 AS len, s_suppkey * 613 % 65536 AS part FROM supplier UNION ALL SELECT 'all', 32, 0),
a4 AS (SELECT DISTINCT l_partkey * 2246822519 % 4294967296 AS n FROM lineitem),
m4 AS (SELECT n, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip, label, len FROM a4 LEFT JOIN net ON (n >> (32 - len)) = (base >> (32 - len))),
a6 AS (SELECT DISTINCT o_custkey * 977 % 65536 AS g FROM orders),
m6 AS (SELECT g, '2001:db8:' || printf('%x', g) || '::1' AS ip, label, len FROM a6 LEFT JOIN six ON (g >> (48 - len)) = (part >> (48 - len)))"""


@query("prefix_lookup", f"{_NETS} SELECT ip, min(label) AS label FROM (SELECT ip, label, len, max(len) OVER (PARTITION BY ip) AS most FROM (SELECT ip, label, len FROM m4 UNION ALL SELECT ip, label, len FROM m6)) WHERE len IS NOT DISTINCT FROM most GROUP BY ip")
def _(s, d):
    n = F.col("s_suppkey")
    dotted = lambda x: F.concat_ws(".", *[(F.floor(x / k) % 256).cast("string") for k in (16777216, 65536, 256, 1)])
    supplier = t(s, d, "supplier")
    four = supplier.select(F.concat(dotted(n * 2654435761 % 4294967296), F.lit("/"), (4 + n % 21).cast("string")).alias("net"), F.concat(F.lit("s"), n.cast("string")).alias("label"))
    six = supplier.select(F.concat(F.lit("2001:db8:"), F.lower(F.hex(n * 613 % 65536)), F.lit("::/"), (33 + n % 14).cast("string")).alias("net"), F.concat(F.lit("x"), n.cast("string")).alias("label"))
    whole = s.createDataFrame([("2001:db8::/32", "all"), ("not a network", "none")], "net string, label string")
    nets = networks.networks(four.unionByName(six).unionByName(whole), "net", "label")
    ips = t(s, d, "lineitem").select(dotted(F.col("l_partkey") * 2246822519 % 4294967296).alias("ip"))
    ips = ips.unionByName(t(s, d, "orders").select(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("o_custkey") * 977 % 65536)), F.lit("::1")).alias("ip"))).distinct()
    return networks.lookup(ips, "ip", nets)

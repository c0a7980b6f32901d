"""Quick questions in English or Spanish, routed to plans by rules."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import correlation, networks, presence, profile, summaries

#: Words for columns
WORDS = {
    "src_ip": ["source ip", "ip de origen", "ips de origen", "origen"],
    "dst_ip": ["destination ip", "ip de destino", "ips de destino", "destino"],
    "user_id": ["users", "user", "usuarios", "usuario"],
    "endpoint": ["endpoints", "endpoint", "paths", "rutas", "ruta"],
    "dst_port": ["ports", "port", "puertos", "puerto"],
    "status_code": ["status", "estados", "estado", "codigo"],
    "event_type": ["event types", "types", "tipos", "tipo"],
    "user_agent": ["user agents", "agents", "navegadores"],
}


def fold(text: str) -> str:
    flat = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub(r"[^a-z0-9_./:=-]+", " ", flat).split())


def column_of(question: str, columns: list[str]) -> str | None:
    """An exact name, a short derived name, else the longest word for a column that exists."""
    q = f" {fold(question)} "
    for c in columns:
        if f" {c.lower()} " in q or (c.startswith("x_") and f" {c[2:].lower()} " in q):
            return c
    found = [(len(w), c) for c, words in WORDS.items() if c in columns for w in words if f" {w} " in q]
    return max(found)[1] if found else next((c for c in ("src_ip", "dst_ip") if c in columns and " ip" in q), None)


def filters_of(question: str, columns: list[str]) -> dict[str, str]:
    out = {c: v for c, v in re.findall(r"(\w+)=(\S+)", question) if c in columns}
    m = re.search(r"(?<![\w/])(/[\w./-]+)", question)
    return out | ({"endpoint": m[1]} if m and "endpoint" in columns else {})


#: Words that point back to the question before
BACK = r"\b(those|these|them|esas|esos|estas|estos|dichas|dichos)\b"


def country_rollup(df: DataFrame, ranges: DataFrame, ip: str, n: int = 20) -> DataFrame:
    """(country, events, ips): public addresses by country, most events first; an address outside all ranges has none.

    ``ranges``: networks (hi, lo, len, label) of either kind of address, or ranges (lo, hi, label) of IPv4 numbers.
    """
    found = df.filter(C.ip_scope(F.col(ip)) == "public").select(F.col(ip).alias("ip"))
    if "len" in ranges.columns:
        named = networks.lookup(found, "ip", ranges)
    else:
        named = correlation.range_lookup(found.withColumn("v", C.ipv4_number(F.col("ip"))).filter("v IS NOT NULL"), ranges, "v")
    out = named.groupBy(F.col("label").alias("country")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("ip").alias("ips"))
    return out.orderBy(F.col("events").desc(), F.col("country").asc_nulls_last()).limit(n)


def address_counts(df: DataFrame) -> DataFrame:
    """(side, ips): different source, destination and, over both, all addresses."""
    sides = [c for c in ("src_ip", "dst_ip") if c in df.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("ip")) for c in sides])).alias("x")
    each = df.select(cells).select("x.side", "x.ip").filter("ip IS NOT NULL")
    return each.unionByName(each.withColumn("side", F.lit("all"))).groupBy("side").agg(F.countDistinct("ip").alias("ips"))


def answer(question: str, df: DataFrame, time_col: str = "timestamp_utc", ranges: DataFrame | None = None, context: dict[str, str] | None = None) -> tuple[str, DataFrame | None]:
    """(kind, result): the first rule that fits; ``unmatched`` without a result otherwise.

    ``ranges``: (lo, hi, label) of countries. ``context``: the filters of the question before, which count again where
    a question points back to them.
    """
    q, cols = fold(question), df.columns
    back = context if context and re.search(BACK, q) else {}
    rows = summaries.filtered(df, {**back, **filters_of(question, cols)})
    col = column_of(question, cols)
    n = next((min(50, int(x)) for x in re.findall(r"\btop (\d+)|\b(\d+) (?:mas|most)", q) for x in x if x), 10)
    n = 1 if re.search(r"\b(which is the|cual es el|cual es la)\b", q) else n
    if re.search(r"\b(country|countries|pais|paises)\b", q) and ranges is not None and {"src_ip", "dst_ip"} & set(cols):
        return "countries", country_rollup(rows, ranges, col if col in ("src_ip", "dst_ip") else "src_ip" if "src_ip" in cols else "dst_ip")
    if re.search(r"\b(columns|columnas|fields|campos)\b", q):
        types = df.sparkSession.createDataFrame(df.dtypes, "col string, type string")
        return "columns", types.join(profile.column_profile(rows, cols), "col", "left").withColumnRenamed("col", "name")
    quoted = re.findall(r"[\"'\u201c\u2018\u00ab]([^\"'\u201d\u2019\u00bb]+)[\"'\u201d\u2019\u00bb]", question)
    if re.search(r"\b(first|last|primera|ultima|seen|aparece|aparecio)\b", q) and quoted:
        names = [c for c in cols if c not in (time_col, "source_row", "timestamp_raw")]
        return "value_seen", presence.of_value(rows, quoted[0], names, time_col).orderBy(F.col("n").desc(), "column")
    if re.search(r"\b(first seen|last seen|primera vez|ultima vez)\b", q) and col:
        return "first_seen", profile.first_last_seen(rows, col, time_col, n)
    if re.search(r"\b(relation|relations|pairs|relaciones|pares|talks? to|habla con|se conecta con)\b", q):
        both = next(((a, b) for a, b in profile.RELATIONS if {a, b} <= set(cols) and (col is None or col in (a, b))), None) or next(((a, b) for a, b in profile.RELATIONS if {a, b} <= set(cols)), None)
        if both:
            return "relations", profile.relations(rows, *both, n)
    if re.search(r"\b(top|most|mas frecuentes?|principales|cual es)\b", q) and col:
        return "top", summaries.top(rows, col, n)
    if re.search(r"\b(how many|cuantas)\b.*\bips?\b", q) and not re.search(r"\b(source|destination|origen|destino)\b", q) and {"src_ip", "dst_ip"} & set(cols):
        return "ip_counts", address_counts(rows)
    if re.search(r"\b(distinct|different|how many|cuantos|cuantas|distintos|distintas|unicos)\b", q) and col:
        return "distinct", rows.agg(F.countDistinct(col).alias("n"))
    if re.search(r"\b(rows|events|filas|eventos|registros)\b", q):
        return "rows", rows.agg(F.count(F.lit(1)).alias("n"))
    if re.search(r"\b(range|period|rango|periodo|desde cuando)\b", q):
        return "range", rows.agg(F.min(time_col).alias("first"), F.max(time_col).alias("last"))
    if re.search(r"\b(empty|null|vacias|vacios|nulos)\b", q):
        return "empty", profile.column_profile(rows, cols).filter("filled = 0").select("col")
    if re.search(r"\b(duplicates?|duplicados?)\b", q):
        return "duplicates", profile.duplicate_rows(rows, [c for c in cols if c not in ("source_row", "timestamp_raw")])
    if re.search(r"\b(gaps?|huecos?|saltos?)\b", q):
        return "gaps", profile.largest_gaps(rows, time_col)
    if re.search(r"\b(peak|busiest|hora pico|hora punta)\b", q):
        return "peak", profile.hour_histogram(rows, time_col).orderBy(F.col("n").desc(), "hour").limit(1)
    if re.search(r"\b(formats?|formatos?)\b", q) and col:
        return "format", profile.value_formats(rows, [col])
    return "unmatched", None

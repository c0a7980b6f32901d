"""Ingest: a mapping compiled to columns of the canonical schema, written with a manifest."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import zoneinfo
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.digest import content_digest
from . import custody, store
from .readers import leaves, open_source, skipped_lines, with_source_row

#: The canonical schema
CORE = {"source_row": "bigint", "timestamp_utc": "timestamp", "src_ip": "string", "user_id": "string", "session_id": "string", "http_method": "string", "host": "string", "endpoint": "string", "query_string": "string", "status_code": "smallint", "user_agent": "string", "referer": "string", "bytes_out": "bigint"}
NETWORK = {"dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string", "action": "string", "rule_name": "string", "application": "string", "bytes_in": "bigint"}
ENDPOINT = {"event_type": "string", "process_name": "string", "command_line": "string", "parent_process": "string", "process_id": "string", "file_path": "string", "file_hash": "string"}
EXTENSIONS = NETWORK | ENDPOINT
DERIVED_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "DOUBLE": "double"}
#: Java patterns for strptime directives, single letters so that missing zeros are accepted
DIRECTIVES = {"Y": "y", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "y": "yy", "z": "Z", "p": "a", "I": "h"}
EPOCHS = {"epoch_s": (1, 1_000_000_000, 2_200_000_000), "epoch_ms": (1000, 1_000_000_000_000, 2_200_000_000_000)}
SPANISH_MONTHS = {"ene": "Jan", "abr": "Apr", "ago": "Aug", "set": "Sep", "dic": "Dec"}
FIXED_OFFSETS = re.compile(r"^(EST|MST|HST|Etc/GMT[+-]\d+)$")


@dataclass
class Mapping:
    """``fields``: canonical name -> raw path; ``timestamp``: field, format, zone; ``derived``: name -> from, regex, type."""

    source: str
    fields: dict[str, str]
    timestamp: dict[str, object]
    derived: dict[str, dict] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    schema: str = "web"

    def validate(self) -> None:
        unknown = set(self.timestamp) - {"field", "format", "timezone", "timezone_in_data", "timezone_fixed_offset"}
        if unknown:
            raise ValueError(f"unknown timestamp keys: {sorted(unknown)}")
        if "field" not in self.timestamp or "format" not in self.timestamp:
            raise ValueError("timestamp needs field and format")
        extra = {"uri", "request_line"}
        bad = [k for k in self.fields if k not in CORE and k not in EXTENSIONS and k not in extra and not k.startswith("x_")]
        if bad:
            raise ValueError(f"not canonical: {bad}")
        need = {"web": [{"uri"}, {"endpoint"}, {"request_line"}], "network": [{"src_ip", "dst_ip"}], "endpoint": [{"host", "process_name"}, {"host", "event_type"}]}
        if self.schema not in need:
            raise ValueError(f"schema: one of {sorted(need)}")
        have = set(self.fields) | set(self.derived)
        if not any(x <= have for x in need[self.schema]):
            raise ValueError(f"{self.schema} needs one of {[sorted(x) for x in need[self.schema]]}")
        for name, d in self.derived.items():
            if d.get("type", "VARCHAR") not in DERIVED_TYPES:
                raise ValueError(f"{name}: type must be one of {sorted(DERIVED_TYPES)}")
            if re.compile(d["regex"]).groups < 1:
                raise ValueError(f"{name}: the pattern needs a group")
            if why := java_error(d["regex"]):
                raise ValueError(f"{name}: {why}")
        check_zone(self.timestamp.get("timezone"), bool(self.timestamp.get("timezone_fixed_offset")))
        outputs = set(CORE) | have | {"endpoint", "query_string", "http_method"}
        if wrong := [r for r in self.roles.values() if r not in outputs]:
            raise ValueError(f"roles name unknown columns: {wrong}")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, default=str).encode()).hexdigest()


def java_error(pattern: str) -> str | None:
    """Why Java's regular expressions, which run it, refuse a pattern; None where no session is up to ask."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # noqa: BLE001  whatever Java says, the pattern does not run
        return str(getattr(e, "java_exception", e)).splitlines()[0]
    return None


def check_zone(zone: object, fixed: bool = False) -> None:
    if zone is None:
        return
    if zone not in zoneinfo.available_timezones():
        raise ValueError(f"not an IANA zone: {zone}")
    if FIXED_OFFSETS.match(str(zone)) and not fixed:
        raise ValueError(f"{zone} is a fixed offset; say timezone_fixed_offset to use it")


def zone_provenance(ts: dict) -> str:
    """in_data, declared or default: where the zone of a timestamp comes from."""
    fmt = str(ts["format"])
    if fmt in EPOCHS or "%z" in fmt or (fmt == "iso8601" and ts.get("timezone_in_data")):
        return "in_data"
    return "declared" if ts.get("timezone") else "default"


def java_pattern(fmt: str) -> str:
    """A strptime pattern as a Java one; literal letters are quoted."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out.append(DIRECTIVES[fmt[i + 1]] if fmt[i + 1] != "%" else "%")
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out).replace("''", "")


def _months(text: Column) -> Column:
    for es, en in SPANISH_MONTHS.items():
        text = F.regexp_replace(text, rf"(?i)\b{es}\b", en)
    return text


def naive_time(raw: Column, fmt: str) -> Column:
    """The time as written, without zone; guards against partial dates that Spark would complete."""
    if fmt == "iso8601":
        text = F.regexp_replace(raw.cast("string"), r"(Z|[+-]\d{2}:?\d{2})$", "")
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(_months(raw.cast("string")), F.lit(java_pattern(fmt))).cast("timestamp_ntz")


def utc_time(raw: Column, ts: dict, kind: T.DataType | None = None) -> Column:
    """UTC of a raw value by format and zone; epochs outside the plausible range and unreadable values are null."""
    fmt, zone = str(ts["format"]), ts.get("timezone")
    if fmt in EPOCHS:
        per, lo, hi = EPOCHS[fmt]
        n = raw.try_cast("double")
        return F.when(n.between(lo, hi), F.timestamp_micros((n * (1_000_000 // per)).cast("bigint")))
    if fmt == "native":
        if isinstance(kind, T.TimestampNTZType) and zone:
            return C.local_to_utc(raw.cast("timestamp"), str(zone))
        return raw.try_cast("timestamp")
    if fmt == "iso8601" and ts.get("timezone_in_data"):
        text = raw.cast("string")
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    if "%z" in fmt:
        return F.try_to_timestamp(_months(raw.cast("string")), F.lit(java_pattern(fmt)))
    naive = naive_time(raw, fmt).cast("timestamp")
    return C.local_to_utc(naive, str(zone)) if zone and zone != "UTC" else naive


def dst_counts(df: DataFrame, raw: Column, ts: dict) -> DataFrame:
    """(nonexistent, ambiguous): rows whose local time the zone skips or repeats."""
    zone, n = str(ts["timezone"]), naive_time(raw, str(ts["format"])).cast("timestamp")
    t = F.to_utc_timestamp(n, zone)
    back = F.from_utc_timestamp(t, zone) == n
    steps = [F.expr(f"INTERVAL {m} MINUTES") for m in (30, 60, 120)]
    twice = F.lit(False)
    for s in steps:
        twice = twice | (F.from_utc_timestamp(t + s, zone) == n) | (F.from_utc_timestamp(t - s, zone) == n)
    return df.agg(F.count_if(n.isNotNull() & ~back).alias("nonexistent"), F.count_if(n.isNotNull() & back & twice).alias("ambiguous"))


def _resolve(path: str, found: dict[str, tuple[Column, T.DataType]]) -> tuple[Column, T.DataType]:
    if path not in found:
        near = difflib.get_close_matches(path, list(found), 3, 0.5)
        raise ValueError(f"no field {path}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return found[path]


def _cast(expr: Column, kind: T.DataType, to: str) -> Column:
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        expr = F.to_json(expr)
    return expr.cast("string") if to == "string" else expr.try_cast(to)


def canonical(df: DataFrame, mapping: Mapping) -> DataFrame:
    """The canonical table of a raw one: core columns in order, mapped extensions, timestamp_raw, derived columns.

    Core columns that are not mapped are typed nulls. A ``uri`` is split into endpoint and query string, a
    ``request_line`` into method and uri. All of it is one projection.
    """
    mapping.validate()
    raw = df if "source_row" in df.columns else with_source_row(df)
    found = leaves(raw.schema)
    get = {k: _resolve(v, found) for k, v in mapping.fields.items()}
    cols: dict[str, Column] = {"source_row": F.col("source_row")}
    ts, kind = _resolve(str(mapping.timestamp["field"]), found)
    cols["timestamp_utc"] = utc_time(ts, mapping.timestamp, kind)
    uri = get.get("uri", (None, None))[0]
    if "request_line" in get:
        line = get["request_line"][0].cast("string")
        cols["http_method"] = C.request_method(line)
        uri = C.request_uri(line) if uri is None else uri
    if uri is not None:
        cols["endpoint"], cols["query_string"] = C.url_endpoint(uri.cast("string")), C.url_query(uri.cast("string"))
    for k, (expr, t) in get.items():
        if k not in ("uri", "request_line"):
            cols[k] = _cast(expr, t, (CORE | EXTENSIONS).get(k, "string"))
    for name, d in mapping.derived.items():
        source = cols[d["from"]] if d["from"] in cols else _resolve(d["from"], found)[0]
        cols[name] = C.derived(source.cast("string"), d["regex"], DERIVED_TYPES[d.get("type", "VARCHAR")])
    order = [*CORE, *[k for k in EXTENSIONS if k in cols]]
    tail = [k for k in cols if k not in order]
    out = [(cols[k] if k in cols else F.lit(None).cast(CORE[k])).alias(k) for k in order]
    return raw.select(*out, ts.cast("string").alias("timestamp_raw"), *[cols[k].alias(k) for k in tail])


def quality(df: DataFrame) -> dict:
    """Rows, time range and nulls of every column in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]).first()
    return {"rows": row["rows"], "time_range": [str(row["first"]), str(row["last"])], "nulls": {c: row[f"null_{c}"] for c in df.columns}}


def ingest(spark: SparkSession, path: str, mapping: Mapping, out: str, overwrite: bool = False) -> dict:
    """Read, map, sort by time and row, write Parquet (zstd), and give the manifest.

    The sort is range-partitioned, so that files hold neighbouring times and later filters can skip them. The manifest is
    kept beside the table and names both by the digest of their rows; a table made from other input is not replaced
    unless ``overwrite`` says so. Both are sealed by their bytes too, as chunks of files, whose hashes are tables
    beside it (``custody``).
    """
    raw, spec = open_source(spark, path)
    source, beside = content_digest(raw), f"{out.rstrip('/')}.manifest.json"
    if not overwrite and store.exists(spark, beside) and json.loads(store.read_text(spark, beside))["input"]["sha256"] != source:
        raise ValueError(f"{out} was made from other input; overwrite to replace it")
    table = canonical(raw, mapping)
    table.orderBy("timestamp_utc", "source_row").write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(out)
    written = spark.read.parquet(out)
    facts = quality(written)
    warnings = [f"{c}: all values are null" for c, n in facts["nulls"].items() if n == facts["rows"] and c in mapping.fields]
    if facts["nulls"]["timestamp_utc"]:
        warnings.append(f"timestamp_utc: {facts['nulls']['timestamp_utc']} rows could not be read")
    zone = {"name": mapping.timestamp.get("timezone") or "UTC", "provenance": zone_provenance(mapping.timestamp)}
    if zone["provenance"] == "declared" and zone["name"] != "UTC":
        ts = F.col("timestamp_raw")
        zone |= dst_counts(written, ts, mapping.timestamp).first().asDict()
    if spec.format in ("access", "panos") and (gone := skipped_lines(spark, path, spec.format)):
        warnings.append(f"{gone} lines could not be read")
    seals = {"input": custody.seal(spark, path, f"{out.rstrip('/')}.custody/input"), "output": custody.seal(spark, out, f"{out.rstrip('/')}.custody/output")}
    manifest = {"input": {"path": path, "format": spec.format, "sha256": source}, "output": out, "custody": seals, "data_sha256": content_digest(written), "mapping_sha256": mapping.digest(), "roles": mapping.roles, "log_schema": mapping.schema, "timezone": zone, **facts, "warnings": warnings}
    store.write_text(spark, beside, json.dumps(manifest, default=str, sort_keys=True, indent=1))
    return manifest

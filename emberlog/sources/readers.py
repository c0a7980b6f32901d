"""Scans of raw log files: format detection, CSV/TSV, JSON, Parquet, and Nginx/Apache and PAN-OS text logs."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_records

#: File endings of formats and compressions
ENDINGS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".parquet": "parquet", ".log": "text", ".txt": "text"}
PACKED = (".gz", ".zst", ".bz2")
ACCESS_LOG = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
PANOS = r"(?:^|[\s>])(\d*,\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2},[^,]*,(?:TRAFFIC|THREAT),.*)$"
#: Positions in PAN-OS payloads, counted from 0
PANOS_FIELDS = {"receive_time": 1, "type": 3, "subtype": 4, "generated_time": 6, "src_ip": 7, "dst_ip": 8, "rule_name": 11, "user_id": 12, "application": 14, "source_zone": 16, "destination_zone": 17, "session_id": 22, "src_port": 24, "dst_port": 25, "protocol": 29, "action": 30}
PANOS_TRAFFIC = {"bytes_out": 32, "bytes_in": 33}
PANOS_THREAT = {"url": 31, "threat_id": 32, "category": 33, "severity": 34}
PANOS_LEAST = {"TRAFFIC": 34, "THREAT": 35}
PANOS_DEVICE, PANOS_SERIAL = 52, 2


@dataclass(frozen=True)
class SourceSpec:
    path: str
    format: str
    encoding: str = "UTF-8"
    delimiter: str | None = None
    has_header: bool | None = None
    options: dict = field(default_factory=dict, hash=False)


def head(spark: SparkSession, path: str, lines: int = 50) -> list[str]:
    """First non-empty lines, read by Spark so that any store works; binary files give unusual characters."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(lines).collect()
    return [r[0] for r in rows]


def detect_format(spark: SparkSession, path: str) -> str:
    """By ending, else by the first bytes: PAR1, an opening bracket, a known text log, else CSV."""
    name = path.lower()
    for p in PACKED:
        name = name.removesuffix(p)
    for end, kind in ENDINGS.items():
        if name.endswith(end):
            if kind != "text":
                return kind
            break
    first = head(spark, path)
    if not first:
        raise ValueError("the file is empty")
    if first[0].startswith("PAR1"):
        return "parquet"
    if first[0].lstrip()[:1] in ("{", "["):
        return "json"
    return detect_text_log(first) or "csv"


def detect_text_log(lines: list[str]) -> str | None:
    """panos or access by which pattern more of the lines match; PAN-OS wins ties, none where no line matches."""
    pan, acc = (sum(bool(re.search(rx, x)) for x in lines) for rx in (PANOS, ACCESS_LOG))
    if not pan and not acc:
        return None
    return "panos" if pan >= acc else "access"


def sniff(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str, bool]:
    """Delimiter and header from the first lines; comma and a header where they are not clear."""
    rows = spark.read.option("sep", "\x00").option("encoding", encoding).option("header", False).option("quote", "").csv(path).limit(20).collect()
    sample = "\n".join(r[0] or "" for r in rows)
    try:
        dialect = csv.Sniffer().sniff(sample, ",;\t|")
    except csv.Error:
        return ",", True
    first = next(csv.reader(io.StringIO(sample), dialect), [])
    return dialect.delimiter, bool(first) and not any(x.strip().replace(".", "", 1).isdigit() for x in first)


def open_source(spark: SparkSession, path: str, spec: SourceSpec | None = None) -> tuple[DataFrame, SourceSpec]:
    """The raw table of a file and how it was read; CSV columns are all text, types are decided by the mapping."""
    kind = spec.format if spec else detect_format(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path), spec or SourceSpec(path, kind)
    if kind == "json":
        multi = head(spark, path, 1)[0].lstrip().startswith("[")
        df = spark.read.option("multiLine", multi).option("samplingRatio", 1.0).option("prefersDecimal", False).json(path)
        return df, spec or SourceSpec(path, kind, options={"multiLine": multi})
    if kind in ("access", "panos"):
        lines = (access_log if kind == "access" else panos_log)(spark.read.text(path))
        return lines.filter(~F.col("bad")).drop("bad"), spec or SourceSpec(path, kind)
    encoding = spec.encoding if spec else detect_encoding(spark, path)
    delimiter, header = (spec.delimiter, spec.has_header) if spec and spec.delimiter else sniff(spark, path, encoding)
    delimiter = "\t" if kind == "tsv" else delimiter
    if quoted_breaks(spark, path, encoding):
        # all tasks cut the records; sorting puts those that cross chunks back into their place
        df = csv_records.read(spark, path, delimiter, bool(header), encoding).orderBy("__file", "__number").drop("__file", "__number")
    else:
        df = spark.read.option("sep", delimiter).option("header", bool(header)).option("inferSchema", False).option("encoding", encoding).option("escape", '"').csv(path)
    return df, SourceSpec(path, kind, encoding, delimiter, header)


def skipped_lines(spark: SparkSession, path: str, kind: str) -> int:
    """Lines of a text log, blank ones aside, that its reader leaves out."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return (access_log if kind == "access" else panos_log)(lines).filter("bad").count()


def quoted_breaks(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether some line holds an odd number of quotation marks: a quoted field then goes on in the next line.

    Spark's own reader would read such a file in one task; ``csv_records`` does not, but needs a pass more.
    """
    lines = spark.read.option("sep", "\x00").option("encoding", encoding).option("header", False).option("quote", "").csv(path)
    if not lines.columns:
        return False
    marks = F.regexp_count(F.col(lines.columns[0]), F.lit('"'))
    return not lines.filter(marks % 2 == 1).limit(1).isEmpty()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode, then Latin-1; the whole file is looked at."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


def leaves(schema: T.StructType, most: int = 6) -> dict[str, tuple[Column, T.DataType]]:
    """Dotted path -> (column, type) of every leaf; a flat name with dots gives the same path, the first one wins."""
    out: dict[str, tuple[Column, T.DataType]] = {}

    def walk(fields, path: list[str], depth: int) -> None:
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType) and depth < most:
                walk(f.dataType.fields, here, depth + 1)
            else:
                out.setdefault(".".join(here), (F.col(".".join(f"`{x}`" for x in here)), f.dataType))

    walk(schema.fields, [], 1)
    return out


#: Partitions up to which their offsets go to all tasks: 16 bytes each.
OFFSETS_SENT = 1 << 20


def with_source_row(df: DataFrame, sent: int = OFFSETS_SENT) -> DataFrame:
    """Number rows from 1 in file order, without leaving the JVM.

    A row's place is its partition's offset plus its place there. Offsets are a table of one row for each partition,
    which goes to all tasks up to ``sent`` rows and is joined by partition beyond.
    """
    placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, offset = [], 1
    for p, n in sizes:
        rows.append((p, offset))
        offset += n
    table = df.sparkSession.createDataFrame(rows, "__p long, __first long")
    table = F.broadcast(table) if len(rows) <= sent else table.hint("merge")
    met = placed.join(table, F.col("__part") == F.col("__p"))
    return met.select((F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long").alias("source_row"), *[F.col(f"`{c}`") for c in df.columns])


def access_log(lines: DataFrame) -> DataFrame:
    """Combined or common access log lines as columns; ``bad`` marks lines that do not parse, dashes are empty."""
    names = ["src_ip", "ident", "user_id", "timestamp", "request_line", "status_code", "bytes_out", "referer", "user_agent"]
    cols = [F.regexp_extract("value", ACCESS_LOG, i).alias(n) for i, n in enumerate(names, 1)]
    parsed = lines.select("value", *cols)
    out = parsed.select((F.col("src_ip") == "").alias("bad"), *[F.when(F.col(n) == "-", "").otherwise(F.col(n)).alias(n) for n in names])
    iso = F.date_format(F.try_to_timestamp("timestamp", F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.withColumn("bad", F.col("bad") | iso.isNull()).withColumn("timestamp", iso)


def panos_log(lines: DataFrame) -> DataFrame:
    """PAN-OS TRAFFIC and THREAT lines by field position; lines that are too short are ``bad``.

    The payload is read as CSV, so that quoted fields may hold commas. The device is its name, else its serial number.
    """
    width = PANOS_DEVICE + 1
    payload = F.nullif(F.regexp_extract("value", PANOS, 1), F.lit(""))
    parsed = lines.select(payload.alias("payload"), F.from_csv(payload, F.lit(", ".join(f"f{i} STRING" for i in range(width)))).alias("p"))
    at = lambda i: F.col(f"p.f{i}")
    outside = F.regexp_replace("payload", r'"(?:[^"]|"")*"', "")
    size = F.length(outside) - F.length(F.replace(outside, F.lit(","))) + 1
    kind = at(3)
    least = F.when(kind == "TRAFFIC", PANOS_LEAST["TRAFFIC"]).when(kind == "THREAT", PANOS_LEAST["THREAT"])
    cols = [F.coalesce(at(i), F.lit("")).alias(n) for n, i in PANOS_FIELDS.items()]
    cols += [F.when(kind == k, F.coalesce(at(i), F.lit(""))).alias(n) for k, names in (("TRAFFIC", PANOS_TRAFFIC), ("THREAT", PANOS_THREAT)) for n, i in names.items()]
    device = F.coalesce(F.nullif(at(PANOS_DEVICE), F.lit("")), at(PANOS_SERIAL)).alias("device")
    return parsed.select(F.coalesce(size < least, F.lit(True)).alias("bad"), *cols, device)


def pages_from_text(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of a text document whose pages are cut by form feeds; other readers can give the same table."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)

"""Custody of files by their bytes: a tree of SHA-256 hashes whose leaves are chunks, hashed where they are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Bytes of a chunk, and children of a node.
CHUNK, FAN = 32 << 20, 256


def _session(spark: SparkSession, chunk: int) -> SparkSession:
    """A session that splits files every ``chunk`` bytes, whatever the cluster and the caller's settings are.

    Local files are read without the store's own checksums, which would stop the read of a changed one.
    """
    own = spark.newSession()
    own.conf.set("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    own.conf.set("fs.file.impl.disable.cache", "true")
    for k, v in {"maxPartitionBytes": chunk, "openCostInBytes": chunk, "minPartitionNum": 1}.items():
        own.conf.set(f"spark.sql.files.{k}", str(v))
    return own


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, hash) of each chunk, of lines (file, start, value) in order: their bytes with the line ends."""
    key, state = None, None
    out: list[tuple] = []
    for rb in batches:
        file, start = rb.column(0).to_numpy(), rb.column(1).to_numpy()
        at = 0
        while at < rb.num_rows:
            end = at + 1
            if file[at] == file[-1] and start[at] == start[-1]:
                end = rb.num_rows
            else:
                while end < rb.num_rows and file[end] == file[at] and start[end] == start[at]:
                    end += 1
            now = (int(file[at]), int(start[at]))
            if now != key:
                if state is not None:
                    out.append((*key, state.digest()))
                key, state = now, hashlib.sha256()
            state.update(b"\n".join(rb.column(2).slice(at, end - at).to_pylist()) + b"\n")
            at = end
    if state is not None:
        out.append((*key, state.digest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["file", "start", "hash"])


def leaves(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(name, start, hash) of a file's or folder's chunks, and for each file a leaf at -1 of its name and length.

    A chunk is the lines that begin in a stretch of ``chunk`` bytes; any bytes will do. Whether the last line has an
    end is told by the length. Names are those below ``path``, so that a folder may be moved. Packed files (.gz) are
    hashed as their content. Files whose names begin with _ or . are not read.
    """
    store.ship(spark)
    own = _session(spark, chunk)
    file = F.xxhash64(F.col("_metadata.file_path")).alias("file")
    listed = own.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(file, F.col("_metadata.file_path").alias("full"), F.col("length"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_replace("full", rf"^.*/\Q{root}\E(?=/|$)/?", "")
    listed = listed.select("file", F.when(name == "", F.lit(root)).otherwise(name).alias("name"), "length")
    lines = own.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    lines = lines.select(file, F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    found = lines.mapInArrow(_hashed, "file long, start long, hash binary").join(listed, "file").select("name", "start", "hash")
    return found.unionByName(listed.select("name", F.lit(-1).cast("long").alias("start"), F.unhex(F.sha2(F.concat_ws(":", "name", F.col("length").cast("string")), 256)).alias("hash")))


def root(found: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> str:
    """The tree's root: each file's chunks under its nodes, and files in the order of their names' hashes under those.

    A node is the hash of its children's places and hashes in order. Only the root, and a count for each level, reaches
    the driver.
    """
    at = F.when(F.col("start") < 0, F.lit(0)).otherwise(F.floor(F.col("start") / chunk) + 1).cast("long")
    level = found.select("name", at.alias("at"), "hash")

    def up(df: DataFrame, keys: list[str], place) -> DataFrame:
        child = F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("hash"))))
        text = F.array_join(F.transform(child, lambda x: F.concat_ws(":", x["at"].cast("string"), F.hex(x["hash"]))), ",")
        return df.groupBy(*keys, place.alias("up")).agg(F.unhex(F.sha2(text, 256)).alias("hash")).withColumnRenamed("up", "at")

    while level.agg(F.max("at")).first()[0]:
        level = up(level, ["name"], F.floor(F.col("at") / fan).cast("long"))
    # files: by the hash of their name, 16 hexadecimal digits of it less at each level
    files = level.select(F.sha2(F.concat(F.col("name"), F.lit("/")), 256).alias("at"), "hash")
    many = files.count()
    digits = 0
    while fan * 16**digits < many:
        digits += 1
    while digits > 0:
        files = up(files, [], F.substring("at", 1, digits)).withColumn("at", F.col("at"))
        digits -= 2
    top = up(files, [], F.lit("")).first()
    return top["hash"].hex() if top else hashlib.sha256(b"").hexdigest()


def seal(spark: SparkSession, path: str, out: str, chunk: int = CHUNK) -> dict:
    """Write the leaves of ``path`` to the table ``out`` and give what a manifest keeps: root, bytes of a chunk, leaves."""
    leaves(spark, path, chunk).write.mode("overwrite").parquet(out)
    kept = spark.read.parquet(out)
    return {"root": root(kept, chunk), "chunk": chunk, "leaves": out}


def changes(spark: SparkSession, path: str, sealed: dict) -> DataFrame:
    """(name, start, was, now): chunks that differ from the sealed ones; start -1 is a file's name and length."""
    now = leaves(spark, path, sealed["chunk"]).withColumnRenamed("hash", "now")
    was = spark.read.parquet(sealed["leaves"]).withColumnRenamed("hash", "was")
    both = was.join(now, ["name", "start"], "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("name", "start", F.lower(F.hex("was")).alias("was"), F.lower(F.hex("now")).alias("now"))


def current(spark: SparkSession, path: str, sealed: dict) -> str | None:
    """The root of what is at ``path`` now, by the sealed size of chunks; None where nothing can be read there."""
    try:
        return root(leaves(spark, path, sealed["chunk"]), sealed["chunk"])
    except Exception as e:  # noqa: BLE001  the store's own kind of error
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "does not exist", "No such file")):
            return None
        raise


def holds(spark: SparkSession, path: str, sealed: dict) -> bool:
    """Whether the bytes at ``path`` are those that were sealed; not so if they are gone."""
    return current(spark, path, sealed) == sealed["root"]

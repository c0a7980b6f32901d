"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handed to a per-document function at once; Spark's own Arrow batches may be larger.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's, or a temporary one where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="emberlog-ckpt-")
    sc.setCheckpointDir(path)
    return path


_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Send this package to the executors once for each application, where they do not have it on their path."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        # the driver's file server sends it from here for as long as the application runs
        path = f"{tempfile.mkdtemp(prefix='emberlog-')}/{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return df


def distinct(a: np.ndarray) -> np.ndarray:
    """Distinct values in order, by a sort: many times as fast as numpy's own hashing of them."""
    a = np.sort(a, axis=None)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


#: What clears the caches that a worker keeps from one task to the next.
CACHES: list[Callable[[], None]] = []


def forget() -> None:
    """Drop a worker's caches of other operators before a stage that needs the memory; they fill again when used."""
    for clear in CACHES:
        clear()
    release()


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on and other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable copy in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table_of(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as a table in the shared folder and read again, and a function that deletes it.

    Shuffle files of the write are removed when it ends, which a checkpoint leaves to the driver's garbage collection.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/emberlog-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), lambda: delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; for a file scan, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, bytes_each: int, least: int = 1, text_col: str = "text") -> int:
    """Partitions that hold about ``bytes_each`` of ``df``'s input bytes, so that their number follows the input.

    Where Catalyst cannot know the size (rows from the driver, an RDD or a join), the texts' bytes are summed up.
    """
    size = planned_bytes(df)
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(least, -(-size // bytes_each))


def without(df: DataFrame, names: list[str]) -> list[str]:
    """``df``'s columns but those that an operator's outputs replace (names compare without case)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` text bytes (one row at least)."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def over_slices(batches: Iterator[pa.RecordBatch], width: int, names: list[str], arrow: list[pa.DataType], make: Callable[[], Callable[[list], list]], most: int) -> Iterator[pa.RecordBatch]:
    """The first ``width`` columns of each slice of the batches, and what ``make()`` finds in the texts of the next one.

    Of a slice nothing is held when the next one begins, and each column goes once Arrow has it.
    """
    f = make()
    for whole in batches:
        for b in text_slices(whole, width, most):
            cols = f(b.column(width).to_pylist())
            for i, t in enumerate(arrow):
                cols[i] = pa.array(cols[i], t)
            done = pa.RecordBatch.from_arrays([*b.columns[:width], *cols], [*b.schema.names[:width], *names])
            del b, cols
            yield done
            del done
        del whole
    del f
    release()


def map_text(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list]],
    keep: list[str] | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns computed from whole texts, Arrow batch by Arrow batch, without a shuffle.

    ``make()`` runs once for a task and gives ``f(texts) -> one list of values for each field``.
    ``keep``: the input columns to return (default: all whose names do not clash with ``fields``).
    ``most``: text bytes that ``f`` gets at once; results do not depend on it.
    """
    ship(df)
    names = [f.name for f in fields]
    keep = without(df, names) if keep is None else keep
    src = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text_col}`"].cast("string").alias("__text"))
    out = T.StructType([src.schema[i] for i in range(len(keep))] + fields)
    arrow = [pa_type(f.dataType) for f in fields]
    width = len(keep)

    return src.mapInArrow(lambda batches: over_slices(batches, width, names, arrow, make, most), out)


def pa_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; files are read in place and never copied."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))

"""Small texts, such as manifests, in whatever store Spark reads."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, store = _at(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    where, store = _at(spark, folder)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, store = _at(spark, path)
    store.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False, and nothing written, where there is one already."""
    from . import shared

    where, store = _at(spark, path)
    local = shared.local_path(store.resolvePath(where.getParent()).toString() if store.exists(where.getParent()) else store.makeQualified(where).getParent().toString())
    if local is not None:
        return shared.create_local(f"{local}/{where.getName()}", text)
    try:
        out = store.create(where, False)
    except Exception as e:  # noqa: BLE001  the store's own kind of error
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to a cluster's executors, once for each application: Python workers there may not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or sc.master.startswith("local[") or sc.master == "local":
        return
    root = Path(__file__).resolve().parents[1]
    # the driver's file server sends it from here for as long as the application runs
    path = f"{tempfile.mkdtemp(prefix='emberlog-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or a temporary one of a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    else:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="emberlog-")
    return f"{root}/scratch-{uuid.uuid4().hex}"

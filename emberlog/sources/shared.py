"""A dictionary that several cases share: versions of a manifest, published one after another, whoever writes."""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


class Conflict(RuntimeError):
    """Another writer published first, again and again."""


class SharedDictionary:
    """Aliases of values and the numbers that shifts take off, in a folder of any store.

    A version is a small manifest that names the tables of each column and the shifts. To change something, a writer
    reads the latest version, writes tables of what is new under names of their own, and publishes the next version's
    manifest, which fails where that exists. Then it reads again and starts over, so that no two writers give one value
    two aliases or one alias to two values; readers always see a whole version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        names = store.names(self.spark, f"{self.folder}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def latest(self) -> tuple[int, dict]:
        """(number, manifest) of the last version: {"tables": {column: [path]}, "shifts": {column: number}}."""
        found = self._versions()
        if not found:
            return 0, {"tables": {}, "shifts": {}}
        return found[-1], json.loads(store.read_text(self.spark, f"{self.folder}/versions/{found[-1]:08d}.json"))

    def table(self, column: str, manifest: dict | None = None) -> DataFrame | None:
        """(value, alias) of a column in one version, None where it has none."""
        paths = (manifest or self.latest()[1])["tables"].get(column)
        return self.spark.read.schema("value string, alias string").parquet(*paths) if paths else None

    def _publish(self, number: int, manifest: dict) -> bool:
        return store.create_once(self.spark, f"{self.folder}/versions/{number:08d}.json", json.dumps(manifest, sort_keys=True))

    def _changed(self, change, tries: int) -> dict:
        for attempt in range(tries):
            number, manifest = self.latest()
            wanted, written = change(json.loads(json.dumps(manifest)))
            if wanted == manifest:
                return manifest
            if self._publish(number + 1, wanted):
                return wanted
            for path in written:
                store.delete(self.spark, path)
            time.sleep(min(2.0, 0.05 * 2**attempt))
        raise Conflict(f"{self.folder}: {tries} versions were published meanwhile")

    def extend(self, column: str, df: DataFrame, value_col: str, order_col: str, name: str | None = None, tries: int = 20) -> DataFrame:
        """(value, alias) of the column with the values of ``df`` that it did not know, which go on numbering."""
        from ..operators import privacy

        def change(manifest: dict) -> tuple[dict, list[str]]:
            known = self.table(column, manifest)
            rows = privacy.alias_table(df, value_col, order_col, known, name or privacy.prefix(column))
            if known is not None:
                rows = rows.join(known.select("value"), "value", "left_anti")
            path = f"{self.folder}/tables/{uuid.uuid4().hex}"
            rows.select("value", "alias").write.parquet(path)
            if self.spark.read.schema("value string, alias string").parquet(path).isEmpty():
                store.delete(self.spark, path)
                return manifest, []
            manifest["tables"].setdefault(column, []).append(path)
            return manifest, [path]

        return self.table(column, self._changed(change, tries))

    def base(self, column: str, df: DataFrame, tries: int = 20) -> float | None:
        """The number that a shift of the column takes off: the minimum of the first case that has one."""

        def change(manifest: dict) -> tuple[dict, list[str]]:
            if column not in manifest["shifts"]:
                low = df.agg(F.min(column)).first()[0]
                if low is not None:
                    manifest["shifts"][column] = low
            return manifest, []

        return self._changed(change, tries)["shifts"].get(column)


def local_path(path: str) -> str | None:
    """The path of a local file, None for other stores."""
    told = urlparse(path)
    return unquote(told.path) if told.scheme in ("", "file") else None


def create_local(path: str, text: str) -> bool:
    """Put a whole file in place unless there is one: a link to a finished file either appears or fails."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    made = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with open(made, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(made, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(made)

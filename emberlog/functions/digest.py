"""Digests of tables that do not depend on the order or the storage of their rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_digest(df: DataFrame) -> str:
    """SHA-256 over the schema and an order-free sum of all rows' hashes: equal tables agree however they are stored."""
    cols = [F.to_json(F.col(f"`{c}`")) if k.startswith(("map", "struct", "array")) else F.col(f"`{c}`") for c, k in df.dtypes]
    # a null leaves a hash as it is, so each row also says which cells are null
    gaps = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    sums = [F.sum(F.xxhash64(F.lit(seed), gaps, *cols).cast("decimal(20,0)")) for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(json.dumps([df.schema.json(), *map(str, row)]).encode()).hexdigest()

"""Tables of countries by address range, IPv4 and IPv6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import networks


def geo_networks(spark: SparkSession, path: str) -> DataFrame:
    """(hi, lo, len, label) of a CSV with start, end and country, or with network and country; a header may be missing.

    Ranges may be nested, and of either kind of address: the longest prefix counts. The header's row names no address
    and is left out like any other row without one.
    """
    t = spark.read.option("header", False).option("inferSchema", False).csv(path)
    if len(t.columns) >= 3 and not t.filter(F.col(t.columns[1]).rlike(r"^\s*[0-9A-Fa-f:.]*[:.][0-9A-Fa-f:.]*\s*$")).isEmpty():
        return networks.networks(t, t.columns[0], t.columns[2], t.columns[1])
    return networks.networks(t, t.columns[0], t.columns[1])

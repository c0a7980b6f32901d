"""Longest-prefix match of IPv4 and IPv6 addresses: one equality key for each prefix length in use, the longest wins."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from ..sources import store

#: IPv4 addresses stand in the IPv6 block ::ffff:0:0/96, so that one key serves both.
MAPPED = 0xFFFF << 32


def bits(ip: Column) -> Column:
    """(hi, lo): the 128 bits of an address as two longs, null where the text is none."""

    def joined(g: Column) -> Column:
        half = lambda at: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.get(g, F.lit(at + i)).cast("long"), 48 - 16 * i) for i in range(4)])
        return F.when(g.isNotNull(), F.struct(half(0).alias("hi"), half(4).alias("lo")))

    v = F.trim(ip)
    four = F.struct(F.lit(0).cast("long").alias("hi"), C.ipv4_number(v).bitwiseOR(F.lit(MAPPED)).alias("lo"))
    return F.when(v.rlike(V.STRICT_IPV4), four).when(F.contains(v, F.lit(":")), C.let(C._v6_groups(ip), joined))


def _mask(half: Column, kept: int) -> Column:
    return F.lit(0).cast("long") if kept <= 0 else half if kept >= 64 else half.bitwiseAND(F.lit(-1 << (64 - kept)))


def cover(first: int, last: int) -> Iterator[tuple[int, int]]:
    """(base, length) of the fewest prefixes of 128-bit numbers that make up a range."""
    while first <= last:
        size = min((first & -first).bit_length() - 1 if first else 128, (last - first + 1).bit_length() - 1)
        yield first, 128 - size
        first += 1 << size


def _number(text: str) -> tuple[int, int]:
    """(number, bits that IPv4 has less than IPv6) of an address."""
    a = ipaddress.ip_address(text.strip())
    return (int(a) | MAPPED, 96) if a.version == 4 else (int(a), 0)


def _prefixes(start: str | None, end: str | None) -> list[tuple[int, int]]:
    """Prefixes of a network (``end`` null) or of a range; nothing where the texts are neither."""
    try:
        if end is None:
            n = ipaddress.ip_network((start or "").strip(), strict=False)
            base, extra = _number(str(n.network_address))
            return [(base, n.prefixlen + extra)]
        (a, x), (b, y) = _number(start or ""), _number(end)
        return list(cover(a, b)) if x == y else []
    except ValueError:
        return []


def networks(df: DataFrame, start: str, label: str, end: str | None = None) -> DataFrame:
    """(hi, lo, len, label) of a table of networks in CIDR form, or of ranges where ``end`` names their last address.

    Rows that are neither are left out. A prefix that several rows give has the least label.
    """
    store.ship(df.sparkSession)
    src = df.select(F.col(start).cast("string").alias("a"), (F.col(end).cast("string") if end else F.lit(None).cast("string")).alias("b"), F.col(label).cast("string").alias("label"))
    ranged = end is not None

    def run(batches):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for rb in batches:
            rows = []
            for a, b, name in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                for base, length in _prefixes(a, (b or "") if ranged else None):
                    rows.append((signed(base >> 64), signed(base & (1 << 64) - 1), length, name))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["hi", "lo", "len", "label"])

    found = src.mapInArrow(run, "hi long, lo long, len int, label string")
    return found.groupBy("hi", "lo", "len").agg(F.min("label").alias("label"))


def lookup(df: DataFrame, ip: str, nets: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with the label of the longest prefix that holds each row's address; null where none does.

    Only the different addresses are searched, each once for each length in use, of which there are 129 at most; rows
    meet what was found by their address. No side has to fit into memory.
    """
    lengths = sorted(r["len"] for r in nets.select("len").distinct().collect())
    named = df.withColumn(label, F.lit(None).cast("string"))
    if not lengths:
        return named
    seen = df.select(F.col(ip).alias("__ip")).filter("__ip IS NOT NULL").distinct().withColumn("b", bits(F.col("__ip"))).filter("b IS NOT NULL")
    keys = F.array(*[F.struct(F.lit(n).alias("len"), _mask(F.col("b.hi"), n).alias("hi"), _mask(F.col("b.lo"), n - 64).alias("lo")) for n in lengths])
    each = seen.select("__ip", F.explode(keys).alias("k")).select("__ip", "k.len", "k.hi", "k.lo")
    best = each.join(nets.select("len", "hi", "lo", F.col("label").alias("__label")), ["len", "hi", "lo"]).groupBy("__ip").agg(F.max_by("__label", "len").alias("__label"))
    return df.join(best, F.col(ip) == F.col("__ip"), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != label], F.col("__label").alias(label))

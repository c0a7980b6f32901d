"""SimHash near-duplicates by deletion-variant signatures: fewer segments, one wildcard bit, equality joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: Buckets with more distinct fingerprints than this are cut again by the other half before they are searched.
BUCKET = 2048


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``shingle`` words in lower case; a shorter text is one run, one without a word has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)] if words else []
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens)
    first = (ends - lens)[: len(words) - shingle + 1].tolist()
    last = (ends - 1)[shingle - 1 :].tolist()
    return [digest(line[s:e], seed) for s, e in zip(first, last, strict=True)]


def fingerprints(texts: list, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text as uint64: the bits that over half of the shingles' XXH64 values have."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    counts, rows = [], []
    for i, t in enumerate(texts):
        found = shingle_hashes(t, shingle, seed)
        if not found:
            continue
        hashes += found
        counts.append(len(found))
        rows.append(i)
    if rows:
        n = np.array(counts)
        start = np.cumsum(n) - n
        h = np.array(hashes, np.uint64)
        ones = np.zeros((len(rows), 64), np.int64)
        step = 200_000
        # runs of documents of about `step` shingles are unpacked at a time; a longer document is summed in pieces
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(start, start[at] + step)))
            if n[at] > step:
                for s in range(start[at], start[at] + n[at], step):
                    ones[at] += _bits(h[s : min(s + step, start[at] + n[at])]).sum(axis=0, dtype=np.int64)
                to = at + 1
            else:
                cut = slice(start[at], start[to - 1] + n[to - 1])
                ones[at:to] = np.add.reduceat(_bits(h[cut]), start[at:to] - start[at], axis=0, dtype=np.int32)
            at = to
        set_bits = 2 * ones > n[:, None]
        out[rows] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def with_fingerprint(df: DataFrame, shingle: int = 3, seed: int = 42, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``fp`` (the 64 bits as a signed long) to each row; a null or empty text has fingerprint zero."""

    def make():
        return lambda texts: [fingerprints(texts, shingle, seed).view(np.int64)]

    return common.map_text(df, text_col, [T.StructField("fp", T.LongType())], make, keep)


def _forest(fps: np.ndarray, free: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among sorted distinct fingerprints.

    ``free``: the bits that can differ within the bucket. Neighbours are found by flipping up to ``most_bits`` free
    bits and looking the result up, so that the work is linear in the bucket; small buckets are compared directly.
    """
    n = len(fps)
    parent = np.arange(n)

    def union(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal parent
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up

    if n <= 256:
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        i, j = np.nonzero(apart <= most_bits)
        union(i[i < j], j[i < j])
    else:
        bits = [np.uint64(1) << np.uint64(b) for b in range(64) if free >> b & 1]
        for k in range(1, most_bits + 1):
            for flip in combinations(bits, k):
                other = fps ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                i = np.flatnonzero((fps[at] == other) & (fps < other))
                union(i, at[i])
    child = np.flatnonzero(parent != np.arange(n))
    return fps[child], fps[parent[child]]


LOW = (1 << 32) - 1


def _first_key(bit: str) -> str:
    """Key of the variant number ``bit`` (0 to 63): the half it lies in, with that bit deleted, and the bit's number."""
    half = f"(CASE WHEN {bit} < 32 THEN fp & {LOW}L ELSE shiftrightunsigned(fp, 32) END)"
    return f"(shiftleft(CAST({bit} AS BIGINT), 32) | ({half} & ~shiftleft(1L, {bit} % 32)))"


def _second_key(bit: str) -> str:
    """The same with the other half of a crowded bucket, cut into two parts of 16 bits: ``bit`` from 0 to 31."""
    other = f"(CASE WHEN shiftrightunsigned(key, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & {LOW}L END)"
    part = f"(CASE WHEN {bit} < 16 THEN {other} & 65535L ELSE shiftrightunsigned({other}, 16) END)"
    return f"(shiftleft(CAST({bit} AS BIGINT), 16) | ({part} & ~shiftleft(1L, {bit} % 16)))"


def _free_bits(key: int, sub: int | None) -> int:
    """Mask of the bits in which two members of a bucket can differ."""
    bit = key >> 32
    free = 1 << bit  # within its half, only the deleted bit
    other = 32 if bit < 32 else 0
    if sub is None:
        return free | LOW << other
    b = sub >> 16
    part = 0 if b < 16 else 16
    return free | 1 << (other + b) | 65535 << (other + 16 - part)


_LINK = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _search(batches: Iterator[pa.RecordBatch], most_bits: int, crowded: int | None) -> Iterator[pa.RecordBatch]:
    """Link the members of each bucket of rows sorted by (key[, sub], fp).

    Rows out: (null, a, b) for a link; with ``crowded``, (key, fp, null) for each member of a larger bucket, which is
    passed on as it streams by. At most ``crowded`` members, or the bounded number that two keys leave, are held.
    """
    keys: list[np.ndarray] = []
    held: list[np.ndarray] = []
    current, count = None, 0

    def batch(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()) if key is not None else pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], names=["key", "a", "b"])

    def close():
        if count < 2 or not held:
            return None
        fps = common.distinct(np.concatenate(held).view(np.uint64))
        a, b = _forest(fps, _free_bits(current[0], current[1]), most_bits)
        return (a.view(np.int64), b.view(np.int64)) if len(a) else None

    for rb in batches:
        if not rb.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
        key, fp = cols[0], cols[-1]
        sub = cols[1] if len(cols) == 3 else None
        change = np.r_[True, (key[1:] != key[:-1]) | ((sub[1:] != sub[:-1]) if sub is not None else False)]
        start = np.flatnonzero(change)
        ends = np.r_[start[1:], len(key)]
        links = []
        # buckets that begin and end inside this batch with one member need no work
        alone = (ends - start == 1) & (np.arange(len(start)) > 0) & (np.arange(len(start)) < len(start) - 1)
        for s, e in zip(start[~alone].tolist(), ends[~alone].tolist(), strict=True):
            now = (int(key[s]), None if sub is None else int(sub[s]))
            if now != current:
                if (got := close()) is not None:
                    links.append(got)
                current, count, held = now, 0, []
            count += e - s
            if crowded is not None and count > crowded:
                out = [*held, fp[s:e]]
                held = []
                members = np.concatenate(out)
                yield batch(np.full(len(members), now[0]), members, None)
            else:
                held.append(fp[s:e])
        if links:
            yield batch(None, np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))
    if current is not None and (got := close()) is not None:
        yield batch(None, *got)


def links(fps: DataFrame, crowded: int = BUCKET) -> DataFrame:
    """(a, b): a spanning forest of the links among distinct fingerprints (column ``fp``), 2 or fewer bits apart.

    Of two halves of 32 bits, one differs in at most one bit: its 32 one-bit deletion variants are equality keys, so
    that linked fingerprints meet in a bucket. Buckets are sorted runs of a shuffle by key and are searched as they
    stream by, with work linear in their size. A bucket with over ``crowded`` members is dealt out again by the
    variants of its other half's two parts; there at most 18 bits remain free, which bounds a bucket by 2^18.
    """
    common.ship(fps)
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(F.expr(_first_key("bit")).alias("key"), "fp")
    first = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda it: _search(it, 2, crowded), _LINK)
    first = common.checkpoint(first)
    again = first.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    again = again.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).select("key", F.expr(_second_key("bit")).alias("sub"), "fp")
    second = again.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(lambda it: _search(it, 2, None), _LINK)
    return first.filter("key IS NULL").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id that links of 2 or fewer differing bits reach.

    Copies are folded into one fingerprint before links are searched, so groups of any size cost one member. Rows with
    a null, empty or blank text share fingerprint zero and link like any other. Repeated rows are kept. An empty
    table gives an empty one. A text of any length is hashed whole, in one worker. Of the input only id and text are
    read, so that other columns may have any name.
    """
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = common.checkpoint(with_fingerprint(src, text_col="__text", keep=["__id"]))
    reps = common.checkpoint(rows.groupBy("fp").agg(F.min("__id").alias("rep")))
    roots = components(links(reps.select("fp")))
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def one_of_each(df: DataFrame, groups_of: Callable[[DataFrame, str, str], DataFrame] = near_duplicates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that stay when each group keeps one: that of its smallest id.

    ``groups_of(rows, id column, text column)`` gives (id, component_id) for each row. A document is an id and a text:
    rows without an id are told apart by their texts and come after those with one, and of rows that repeat an id with
    other texts each is a document of its own. Of rows that repeat both, the one of least hash stays, so that reruns
    agree. No group loses all its rows.
    """
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("text"))
    groups = groups_of(df.select(key.alias("__key"), text.alias("__text")), "__key", "__text")
    stay = groups.filter(F.col("__key") == F.col("component_id")).groupBy(F.col("__key").alias("__stay")).agg(F.count(F.lit(1)).alias("__n"))
    stay = common.checkpoint(stay)
    alone = df.join(stay.filter("__n = 1"), key == F.col("__stay"), "left_semi")
    many = stay.filter("__n > 1")
    if many.isEmpty():
        return alone
    # the least of each is found before rows move
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    again = df.join(many, key == F.col("__stay")).groupBy("__stay").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
    return alone.unionByName(again.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(df.columns)]))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

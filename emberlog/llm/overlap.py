"""Near-duplicates by the Jaccard similarity of shingle sets: SimHash links and a prefix filter, verified on whole sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kneser_ney, simhash, substring_dedup
from .components import components

#: Documents of which shingles are counted to find frequent ones, and how many of those the order of shingles knows.
SAMPLE_DOCS, FREQUENT = 10_000, 50_000
#: Bits of the parity bitmap that a set takes into a bucket, in words of 64; its own has two bits for each hash or more.
WORDS = 32
#: Members that are compared with one leader in one place; a larger group is dealt to several.
CROWD = 2048
#: Orders in which a bucket's members are joined before all pairs that are left are tried.
SEEDS = (1,)
#: Bits of the filter that picks the documents of candidate pairs before their texts move.
PICK = 1 << 22


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; the words of a shorter text are one shingle."""
    return common.distinct(np.array(simhash.shingle_hashes(text, shingle, seed), np.uint64))


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes at each bit: two bitmaps differ in at most as many bits as their sets.

    Its size is a power of two that grows with the set; it can be folded to a smaller one.
    """
    size = max(64 * WORDS, 1 << (2 * len(hashes)).bit_length())
    odd = np.bincount((hashes >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


#: Bytes of input files for each shard of hashes.
SHARD_BYTES = 8 << 20
#: Bits of a hash beyond those that number all shingles: as much of them seem shared by chance as one in two to that power.
SPARE_BITS = 7


def _simhash(h: np.ndarray) -> int:
    return int(np.packbits(2 * simhash._bits(h).sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view("<i8")[0]) if len(h) else 0


def _sets_of_block(t: pa.Table, shingle: int, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(set of each row, distinct cut hashes of the block, whether two sets of the block hold one)."""
    sets = [shingle_set(x.as_py(), shingle) for x in t.column("__text")]
    once = {_name(h): h for h in sets}
    cut = [common.distinct(h >> np.uint64(64 - bits)) for h in once.values()]
    every = np.sort(np.concatenate(cut)) if cut else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return sets, every[first], np.diff(np.r_[first, len(every)]) > 1


def _with_keys(src: DataFrame, shingle: int, share: float, frequent: dict[int, int]) -> DataFrame:
    """(__id, fp, n, sim, hashes, bits, small): the name of each row's set and, where it may have a partner, its keys.

    Shingles that no other set holds come first in the order of the prefix filter and need no key. So only a set of
    which ``share`` is held by others has keys: of its shared shingles in the prefix, frequent ones last. Which are
    shared is found as repeated passages are: blocks of documents send their distinct hashes, just long enough to tell
    the corpus' shingles apart, sorted and packed, to shards, which answer with a bit for each. A chance collision
    makes a shingle seem shared everywhere, so that the order stays one for all sets.
    """
    common.ship(src)
    keys = np.array(sorted(frequent), np.uint64)
    counts = np.array([frequent[int(k)] for k in keys], np.int64)
    blocks, shards = common.parts_for(src, kneser_ney.BLOCK_BYTES, text_col="__text"), common.parts_for(src, SHARD_BYTES, text_col="__text")
    width = max(1, min(63, 20 + (blocks - 1).bit_length() + SPARE_BITS))
    edges = substring_dedup._shard_edges(shards, width)

    def cuts(h: np.ndarray) -> list[int]:
        return [0, *np.searchsorted(h, edges).tolist(), len(h)]

    def emit(t: pa.Table) -> pa.Table:
        common.forget()
        t = kneser_ney._unpacked(t)
        _, h, _ = _sets_of_block(t, shingle, width)
        some = [(s, a, b) for s, (a, b) in enumerate(pairwise(cuts(h))) if b > a]
        out = pa.table({"shard": pa.array([s for s, _, _ in some], pa.int32()), "block": pa.array([t.column("__block")[0].as_py()] * len(some), pa.int32()), "hashes": pa.array([substring_dedup.pack_sorted(h[a:b]) for _, a, b in some], pa.binary())})
        del t, h
        common.release()
        return out

    def one(h: np.ndarray, shared: np.ndarray) -> tuple:
        n = len(h)
        room = (n - math.ceil(n * share - 1e-9) + 1 if n else 0) - int((~shared).sum())
        if room <= 0:
            return _name(h), n, None, [], None, None
        k = h[shared]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            k = k[np.lexsort((k, np.where(keys[at] == k, counts[at], 0)))]
        bits = _bitmap(h)
        return _name(h), n, _simhash(h), k[:room].view(np.int64), bits.tobytes(), _folded(bits, WORDS).tobytes()

    def mark(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({f.name: pa.array([], common.pa_type(f.dataType)) for f in out.fields})
        t = kneser_ney._unpacked(t)
        sets, h, shared = _sets_of_block(t, shingle, width)
        at = cuts(h)
        for s, blob in zip(answers.column("shard").to_pylist(), answers.column("seen").to_pylist(), strict=True):
            shared[at[s] : at[s + 1]] |= np.unpackbits(substring_dedup._numbers(blob, np.uint8).ravel(), count=at[s + 1] - at[s]).astype(bool)
        rows = [one(x, shared[np.searchsorted(h, x >> np.uint64(64 - width))] if len(x) else np.zeros(0, bool)) for x in sets]
        found = {f.name: pa.array(list(v), common.pa_type(f.dataType)) for f, v in zip(out.fields[1:], zip(*rows, strict=True), strict=True)}
        done = pa.table({"__id": t.column("__id")} | found)
        del t, sets, h, shared, rows
        common.release()
        return done

    out = T.StructType([src.schema["__id"], *[T.StructField(n, k) for n, k in (("fp", T.LongType()), ("n", T.IntegerType()), ("sim", T.LongType()), ("hashes", T.ArrayType(T.LongType())), ("bits", T.BinaryType()), ("small", T.BinaryType()))]])
    placed = kneser_ney._dealt(src, ["__id"], "__id", "__text")
    sent = placed.groupBy("__block").applyInArrow(emit, "shard int, block int, hashes binary")
    answers = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(substring_dedup._resolve, "__block int, shard int, seen binary")
    return placed.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(mark, out)


def _name(h: np.ndarray) -> int:
    fp = xxhash.xxh64_intdigest(h.tobytes(), 42)
    return fp - (1 << 64) if fp >> 63 else fp


def _whole_sets(src: DataFrame, shingle: int) -> DataFrame:
    """(fp, n, set): whole sets of 64-bit hashes in order."""

    def one(text):
        h = shingle_set(text, shingle)
        return _name(h), len(h), h.tobytes()

    fields = [T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("set", T.BinaryType())]
    return common.map_text(src, "__text", fields, lambda: lambda texts: list(map(list, zip(*map(one, texts), strict=True))), keep=[])


def _frequent(src: DataFrame, shingle: int) -> dict[int, int]:
    """Shingles that recur in a sample of the documents, with their counts there.

    They only order the prefix filter, which is exact under any order: a poor sample costs time, not links.
    """
    step = max(1, -(-src.count() // SAMPLE_DOCS))
    some = src.filter(F.pmod(F.xxhash64("__id"), F.lit(step)) == 0)
    fields = [T.StructField("hashes", T.ArrayType(T.LongType()))]
    h = common.map_text(some, "__text", fields, lambda: lambda texts: [[shingle_set(t, shingle).view(np.int64) for t in texts]], keep=[]).select(F.explode("hashes").alias("h"))
    top = h.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 2").orderBy(F.desc("c"), "h").limit(FREQUENT)
    return {r["h"] % (1 << 64): r["c"] for r in top.collect()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of equal keys (first column) in sorted rows; runs may span batches."""
    held: list[list[np.ndarray]] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
        cuts = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        edges = [0, *cuts.tolist(), len(cols[0])]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            part = [c[s:e] for c in cols]
            if held and held[0][0][0] != part[0][0]:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, n, fp) of keys that two sets or more have, of rows sorted by key and of distinct sets."""
    last, names = None, ["key", "n", "fp"]
    for rb in batches:
        if not rb.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
        if last is not None:
            cols = [np.r_[x, c] for x, c in zip(last[0], cols, strict=True)]
        # the last run's latest row waits for the next batch; an earlier row of its run has been passed on
        same = cols[0][1:] == cols[0][:-1]
        keep = np.r_[same, False] | np.r_[last[1] if last is not None else False, same]
        last = ([c[-1:] for c in cols], bool(keep[-1]))
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)
    if last is not None and last[1]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[0]], names=names)


def _led(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(lead, member): each member of a bucket with its leader, the first of those long enough, of rows sorted by key, n and fp.

    Of a bucket only the first member of each length is held, so its size does not matter.
    """
    key, sizes, firsts = None, [], []
    for rb in batches:
        if not rb.num_rows:
            continue
        keys, n, fp = (c.to_numpy(zero_copy_only=False) for c in rb.columns)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        out = np.empty(len(keys), np.int64)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if keys[s] != key:
                key, sizes, firsts = keys[s], [], []
            part, who = n[s:e], fp[s:e]
            for i in np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist():
                if not sizes or sizes[-1] != part[i]:
                    sizes.append(part[i])
                    firsts.append(who[i])
            out[s:e] = np.array(firsts)[np.searchsorted(np.array(sizes), part * share - 1e-6)]
        some = out != fp
        yield pa.RecordBatch.from_arrays([pa.array(out[some]), pa.array(fp[some])], names=["lead", "member"])


def _near(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, b, n_a, n_b, bits_a, bits_b) that lengths and whole bitmaps allow to be alike."""
    slack = (1 - share) / (1 + share)
    for rb in batches:
        a, b, n_a, n_b = (c.to_numpy(zero_copy_only=False) for c in rb.columns[:4])
        fits = np.flatnonzero(np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b) - 1e-6)
        keep = []
        for i in fits.tolist():
            x, y = (np.frombuffer(c[i].as_py(), "<u8") for c in rb.columns[4:])
            words = min(len(x), len(y))
            if int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= slack * (int(n_a[i]) + int(n_b[i])) + 1e-6:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
    common.release()


def _pairs(batches: Iterator[pa.RecordBatch], share: float, seed: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket's members with different roots that lengths and bitmaps allow to be alike; rows: key, n, fp, root, bits.

    Both bounds are exact: alike sets differ in at most (1 - share) / (1 + share) of their summed sizes. With a
    ``seed``, members are taken in an order of its own and a pair only where it joins what the pairs before it leave
    apart: one member fewer than the bucket has at most. Without, all such pairs come.
    """
    out_a, out_b, held = [], [], 0
    slack = (1 - share) / (1 + share)
    for _, n, fp, root, small in _runs(batches):
        m = len(fp)
        if m < 2 or (root == root[0]).all():
            continue
        bits = np.frombuffer(b"".join(small.tolist()), "<u8").reshape(m, WORDS)
        if seed is not None:
            order = np.argsort((fp.view(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
            n, fp, bits, root = n[order], fp[order], bits[order], np.unique(root, return_inverse=True)[1][order]
        for i in range(m - 1):
            if seed is None:
                j = np.arange(i + 1, int(np.searchsorted(n, n[i] / share + 1e-6, side="right")))
                j = j[root[j] != root[i]]
            else:
                j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
                j = j[np.minimum(n[j], n[i]) >= share * np.maximum(n[j], n[i]) - 1e-6]
            if not len(j):
                continue
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            at = j[apart <= slack * (n[j] + n[i]) + 1e-6]
            if seed is not None and len(at):
                met, first = np.unique(root[at], return_index=True)
                at = at[first]
                joined = np.zeros(m, bool)
                joined[met] = True
                root[joined[root]] = root[i]
            if len(at):
                out_a.append(np.full(len(at), fp[i]))
                out_b.append(fp[at])
                held += len(at)
        if held > 50_000:
            yield _pair_batch(out_a, out_b)
            out_a, out_b, held = [], [], 0
    if held:
        yield _pair_batch(out_a, out_b)
    common.release()


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack([np.concatenate(a), np.concatenate(b)], axis=1) if a else np.zeros((0, 2), np.int64)
    both = np.unique(np.stack([both.min(axis=1), both.max(axis=1)], axis=1), axis=0) if len(both) else both
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, salt, b, n, set), sorted, in which the row without b is a's own set, when their sets are alike."""
    lead, own = None, None
    for rb in batches:
        out_a, out_b = [], []
        for a, salt, b, n, raw in ((c[i].as_py() for c in rb.columns) for i in range(rb.num_rows)):
            if b is None:
                lead, own = (a, salt), (n, np.frombuffer(raw, "<u8"))
                continue
            if lead != (a, salt):
                continue
            other = np.frombuffer(raw, "<u8")
            # sets are sorted: what both hold is where one finds itself in the other
            both = 0
            if len(other) and len(own[1]):
                at = np.minimum(np.searchsorted(own[1], other), len(own[1]) - 1)
                both = int((own[1][at] == other).sum())
            if both >= share * (n + own[0] - both) - 1e-9:
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
    common.release()


def links(prefixes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], share: float) -> DataFrame:
    """(a, b): links among distinct sets (fp, n, sim, hashes, bits, small) that join all pairs of Jaccard similarity ``share``.

    Two such sets share one of their first n - ceil(share n) + 1 hashes in a common order, which is an equality key.
    The first round verifies the links of SimHash's deletion variants; the exact search that follows takes what they
    join as joined. Its first round tries each set with the leader that it meets in most of its buckets, if that is of
    another component. In later rounds a bucket proposes a spanning forest of the pairs that bounds allow between its
    components, so that a large group of copies costs pairs in proportion to its size; the last tries all pairs
    between components that remain, so that no link is missed. ``sets_of`` gives the whole sets (fp, n, set) of a column
    ``fp``; only those of candidate pairs are asked for, and a pair moves one of its two sets. What is written between
    the steps is deleted at the end, and shuffles with the step that made them.
    """
    written: list[Callable[[], None]] = []

    def kept(df: DataFrame) -> DataFrame:
        out, forget = common.table_of(df)
        written.append(forget)
        return out

    keyed = prefixes.select(F.explode("hashes").alias("key"), "n", "fp")
    met = kept(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, n int, fp long"))

    def near(pairs: DataFrame) -> DataFrame:
        sides = [prefixes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b")]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        return both.mapInArrow(lambda it: _near(it, share), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        known = kept(sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()))
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
        placed = pairs.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        rows = placed.join(known.withColumnRenamed("fp", "b"), "b").select("a", "salt", "b", "n", "set")
        own = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(known.withColumnRenamed("fp", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "set")
        dealt = rows.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        out = kept(dealt.mapInArrow(lambda it: _alike(it, share), "a long, b long"))
        written.pop(-2)()
        return out

    tried = found = roots = None

    def attempt(pairs: DataFrame) -> bool:
        """Verify those of ``pairs`` (a, b) that bounds allow and that are new; whether there were any."""
        nonlocal tried, found, roots
        rest = kept(near(pairs if tried is None else kept(pairs.join(tried, ["a", "b"], "left_anti"))))
        if found is not None and rest.isEmpty():
            return False
        new = verified(rest)
        found, tried = (new, rest) if found is None else (kept(found.unionByName(new)), kept(tried.unionByName(rest)))
        roots = None
        return True

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        """``rows`` with the class of ``node``, as far as links have been found: its own name where none has."""
        nonlocal roots
        roots = kept(components(found)) if roots is None else roots
        return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b")).distinct()

    # SimHash alone comes first: sets of one are tried with the first of them, those of linked ones first with first
    lead = prefixes.groupBy("sim").agg(F.min("fp").alias("lead"))
    same = prefixes.join(lead, "sim").filter("fp != lead").select("lead", F.col("fp").alias("member"))
    close = simhash.links(lead.select(F.col("sim").alias("fp")))
    close = close.join(lead.select(F.col("sim").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("sim").alias("b"), F.col("lead").alias("member")), "b").select(F.col("x").alias("lead"), "member")
    attempt(ordered(same.unionByName(close)))
    # what SimHash has joined stays joined: leaders are for sets that it leaves apart
    led = met.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(lambda it: _led(it, share), "lead long, member long")
    votes = led.groupBy("lead", "member").agg(F.count(F.lit(1)).alias("c")).groupBy("member").agg(F.max(F.struct("c", "lead")).alias("v")).select("v.lead", "member")
    attempt(ordered(rooted(rooted(votes, "lead", "root"), "member", "other").filter("root != other")))
    # then what joins components by few pairs, in orders of their own; at last all pairs that are left
    seeds = [*SEEDS, None]
    while seeds:
        seed = seeds.pop(0)
        members = rooted(met, "fp", "root")
        mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
        some = members.join(mixed, "key", "left_semi").join(prefixes.select("fp", "small"), "fp").select("key", "n", "fp", "root", "small")
        pairs = some.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(partial(_pairs, share=share, seed=seed), "a long, b long").distinct()
        if not attempt(pairs):
            # no order proposes anything new: what is left, if anything, is for the last round
            seeds = seeds[-1:]
    out = common.checkpoint(found)
    for forget in written:
        forget()
    return out


def _picked(src: DataFrame, ids: DataFrame) -> DataFrame:
    """A superset of the rows of ``src`` with an id in ``ids``, found without moving ``src``: one bit for each hash."""
    spot = F.pmod(F.xxhash64("__id"), F.lit(PICK))
    marks = ids.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("m"))
    words = np.zeros(PICK >> 6, np.int64)
    for r in marks.collect():
        words[r["w"]] = r["m"]
    filled = src.sparkSession.createDataFrame([(words.tolist(),)], "marks array<bigint>")
    # one row; PICK bounds it
    hit = F.expr("shiftrightunsigned(marks[CAST(shiftright(__spot, 6) AS INT)], CAST(__spot % 64 AS INT)) & 1L = 1L")
    return src.withColumn("__spot", spot).crossJoin(F.broadcast(filled)).filter(hit).select(*src.columns)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id that links of Jaccard similarity ``share`` or more reach.

    Sets are of ``shingle`` words in lower case, known by 64-bit hashes; ``fp`` names a row's set. Every linked pair
    of sets is found: no bound or random draw leaves one out. Rows without a word have the empty set and link to each
    other alone. Ids may be of any type that has an order; null ids are one id, dealt by text, and the smallest id of a
    group is null only if all are. Texts of any length are read whole. Repeated rows are kept; an empty table gives an
    empty one.
    """
    common.ship(df)
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    whole, forget = common.table_of(_with_keys(src, shingle, share, _frequent(src, shingle)))
    # one row for each set that may have a partner: copies are folded before links are searched
    sets, forget_sets = common.table_of(whole.drop("__id").filter(F.size("hashes") > 0).dropDuplicates(["fp"]))
    rows = common.checkpoint(whole.select("__id", "fp"))
    forget()
    reps = common.checkpoint(rows.groupBy("fp").agg(F.min("__id").alias("rep")))

    def sets_of(fps: DataFrame) -> DataFrame:
        ids = reps.join(fps, "fp").select(F.col("rep").alias("__id"))
        return _whole_sets(_picked(src, ids), shingle).join(fps, "fp", "left_semi").dropDuplicates(["fp"])

    roots = components(links(sets, sets_of, share))
    forget_sets()
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")

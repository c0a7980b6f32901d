"""Phrase collocations by pivot partitioning: each n-gram is counted where its rarest word's text fragments are sent."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Text bytes of a block, whose words are numbered together.
BLOCK_BYTES = 8 << 20
#: Fragments of a bucket, which is mined at once, and occurrences from which a pivot's fragments are dealt to several.
BUCKET_FRAGMENTS, HOT = 1 << 20, 1 << 20
#: Parts in which a language's phrases are ranked before they are ranked together.
PARTS = 64
#: Bytes that end a piece, and the white space within one. Fixed values of the contract.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

#: floor(1000000 a a / (l r)) in decimals of up to 38 digits, which hold counts of up to 10^15.
SCORE = "CAST((CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0))) AS BIGINT)"
#: Lower case for A-Z, one mark for all ends, one space for all blanks; the mark can be no word, because it is an end.
_FOLD = bytes(ord(b".") if c in ENDS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Block:
    """Words of documents in one language, numbered as they come; 0 is the end of a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> None:
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b".", b" . ").split()
        new = set(words).difference(self.number)
        if new:
            self.number.update(zip(new, count(len(self.number) + 1)))
        at = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        self.parts.append(at)
        self.parts.append(np.zeros(1, np.uint32))

    def row(self, block: int, lang: str) -> tuple:
        seq = np.concatenate(self.parts)
        mark = self.number.pop(b".", None)
        if mark is not None:
            seq[seq == mark] = 0
            seq -= seq > mark
        words = list(self.number)
        counts = np.bincount(seq, minlength=len(words) + 1)[1:]
        return block, lang, [w.decode("utf-8", "surrogatepass") for w in words], counts.tolist(), seq.astype(_width(len(words))).tobytes()


def _width(words: int) -> str:
    return "<u2" if words < 1 << 16 else "<u4"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """(block, lang, words, counts, seq) of rows (lang, text): blocks end where texts have come to ``block_bytes``."""
    number = count(TaskContext.get().partitionId() << 32)
    names = ["block", "lang", "words", "counts", "seq"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
    held: dict[str, _Block] = {}
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        # each language of a block is a block of its own
        for lang, block in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block.row(next(number), lang), kinds, strict=True)], names=names)

    for rb in batches:
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
            text = text.as_py()
            held.setdefault(lang, _Block()).add(text)
            size += len(text)
            if size >= block_bytes:
                yield from done()
                held, size = {}, 0
    yield from done()
    common.release()


def fragments(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rewritten fragments of a text of word ids, one column for each: pivot in the middle, ``longest`` - 1 words around.

    Words are numbered from 1 by falling frequency, 0 is a gap: an infrequent word or the end of a piece. At each word
    the neighbours are kept up to the first gap or rarer word, which is rewritten as a gap; on the left an equal word
    is one too, so that an n-gram that holds its rarest word twice belongs to the first. Fragments without a neighbour go.
    """
    n, side = len(ids), longest - 1
    out = np.zeros((2 * side + 1, n), ids.dtype)
    out[side] = ids
    for step in (-1, 1):
        open_ = ids > 0
        for k in range(1, min(side, n - 1) + 1):
            near = np.zeros(n, ids.dtype)
            if step < 0:
                near[k:] = ids[:-k]
                open_ = open_ & (near > 0) & (near < ids)
            else:
                near[:-k] = ids[k:]
                open_ = open_ & (near > 0) & (near <= ids)
            out[side + step * k] = np.where(open_, near, 0)
    return out[:, (out[side - 1] > 0) | (out[side + 1] > 0)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _row_hash(cols: np.ndarray) -> np.ndarray:
    h = np.zeros(cols.shape[1], np.uint64)
    for c in cols:
        h = _mix(h * np.uint64(31) + c.astype(np.uint64) + np.uint64(1))
    return h


def folded(cols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct columns, their summed counts, their hashes), ordered by hash; equal hashes are told apart by the columns."""
    h = _row_hash(cols)
    order = np.argsort(h, kind="stable")
    if len(order) and (h[order][1:] == h[order][:-1]).any():
        order = np.lexsort((*cols, h))
    cols, counts, h = cols[:, order], counts[order], h[order]
    first = np.flatnonzero(np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)]) if len(h) else np.zeros(0, np.int64)
    return cols[:, first], np.add.reduceat(counts, first) if len(first) else counts, h[first]


def mined(cols: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams as columns, counts) of fragments, those that hold the pivot and occur ``least`` times or more, by length.

    A longer n-gram that is frequent begins or ends with a frequent one that holds the pivot too: others are not counted.
    """
    side = len(cols) // 2
    # hashes of the frequent n-grams of the length before, to which longer ones are held
    before = None
    for length in range(2, side + 2):
        parts, weights = [], []
        for first in range(side - length + 1, side + 1):
            gram = cols[first : first + length]
            keep = (gram > 0).all(axis=0)
            gram, weight = gram[:, keep], counts[keep]
            if before is not None:
                holds = np.ones(gram.shape[1], bool)
                if first + length - 1 > side:
                    holds &= _among(_row_hash(gram[:-1]), before)
                if first < side:
                    holds &= _among(_row_hash(gram[1:]), before)
                gram, weight = gram[:, holds], weight[holds]
            parts.append(gram)
            weights.append(weight)
        gram, weight, h = folded(np.concatenate(parts, axis=1), np.concatenate(weights))
        some = weight >= least
        gram, weight = gram[:, some], weight[some]
        # sorted, because columns come in the order of their hashes
        before = h[some] if least > 1 else None
        yield gram, weight


def _among(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(h), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


def phrases(df: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET_FRAGMENTS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((ids, a), (id, lang, word, f)): phrases of 2 to ``longest`` words with a >= ``least`` occurrences, and all words.

    Words that occur ``least`` times have ids from 1 by falling frequency, others none. Blocks of texts number their
    own words; the ids come back to the block by a join on words, so that no table of all words is held anywhere. Then
    a block rewrites its text into fragments for each pivot, folds equal ones and packs them by bucket of pivots. A
    pivot of over ``hot`` occurrences is dealt to several buckets by the fragment's hash, and its counts are added up.
    """
    common.ship(df)
    spark = df.sparkSession
    src = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    cut = src.mapInArrow(lambda it: _blocks((x for rb in it for x in common.text_slices(rb, 1)), block_bytes), "block long, lang string, words array<string>, counts array<long>, seq binary")
    blocks, forget_blocks = common.table_of(cut)
    local = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "w")).select("block", "lang", "no", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    every = local.groupBy("lang", "word").agg(F.sum("c").alias("f"))
    # the order by frequency: ids are places within range partitions, beyond those of the partitions before
    ranged = every.repartitionByRange(F.desc("f"), "lang", "word").sortWithinPartitions(F.desc("f"), "lang", "word")
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed, forget_placed = common.table_of(ranged)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("f") >= least, 1)).alias("some"), F.count(F.when(F.col("f") > hot, 1)).alias("hot"), F.sum("f").alias("words"))
    told = sorted(map(tuple, sizes.collect()))  # one row for each partition
    offsets = spark.createDataFrame([(p, int(o)) for (p, *_), o in zip(told, np.cumsum([0, *(x[1] for x in told)]), strict=False)], "part int, before long")
    words, _ = common.table_of(placed.join(offsets, "part").select(F.when(F.col("f") >= least, F.col("before") + F.col("at") + 1).alias("id"), "lang", "word", "f"))
    forget_placed()
    n_ids, n_hot, total = (sum(x[i] for x in told) for i in (2, 3, 4))
    kind = np.dtype("<u4") if n_ids < 1 << 32 else np.dtype("<u8")
    buckets = max(1, -(-total // bucket))
    salts = np.uint64(max(1, -(-max((x[4] for x in told), default=0) // hot)))
    side = longest - 1

    def packed(t: pa.Table, vocab: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "blob"], [pa.int64(), pa.binary()]
        if not t.num_rows or not vocab.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        raw, n = t.column("seq")[0].as_py(), t.column("n")[0].as_py()
        seq = np.frombuffer(raw, _width(n))
        table = np.zeros(n + 1, kind)
        table[vocab.column("no").to_numpy() + 1] = vocab.column("id").to_numpy()
        cols = fragments(table[seq], longest)
        cols, counts, h = folded(cols, np.ones(cols.shape[1], np.int64))
        pivot = cols[side].astype(np.uint64)
        salt = np.where(pivot <= n_hot, h % salts, np.uint64(0))
        to = (_mix(pivot + (salt << np.uint64(40))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cols, counts, to = cols[:, order], counts[order], to[order]
        edges = [*np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist(), len(to)] if len(to) else [0]
        rows = [(int(to[a]), cols[:, a:b].tobytes() + counts[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        common.release()
        return pa.table({k: pa.array(list(v), t) for k, v, t in zip(names, zip(*rows, strict=True) if rows else ([], []), kinds, strict=True)})

    found = local.join(words.filter("id IS NOT NULL").drop("f"), ["lang", "word"]).select(F.col("block").alias("home"), "no", "id")
    texts = blocks.select("block", F.size("words").alias("n"), "seq")
    sent = texts.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(packed, "bucket long, blob binary")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "a", "final"]

        def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            width = kind.itemsize * (2 * side + 1) + 4
            cut = [(np.frombuffer(b, kind, len(b) // width * (2 * side + 1)).reshape(2 * side + 1, -1), np.frombuffer(b, "<u4", offset=len(b) - len(b) // width * 4)) for b in blobs]
            cols, counts = np.concatenate([c for c, _ in cut], axis=1), np.concatenate([c for _, c in cut]).astype(np.int64)
            spread = cols[side] <= n_hot
            for pick, bound in ((~spread, least), (spread, 1)):
                if pick.any():
                    for gram, weight in mined(cols[:, pick], counts[pick], bound):
                        for i in range(0, len(weight), 100_000):
                            some = gram[:, i : i + 100_000]
                            flat = pa.array(np.ascontiguousarray(some.T).ravel().astype(np.int64))
                            ids = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, len(some)), pa.int32()), flat)
                            yield pa.RecordBatch.from_arrays([ids, pa.array(weight[i : i + 100_000]), pa.array(np.full(some.shape[1], bound == least))], names=names)

        current, blobs = None, []
        for rb in batches:
            for b, blob in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if b != current and blobs:
                    yield from done(blobs)
                    blobs = []
                current = b
                blobs.append(blob)
        if blobs:
            yield from done(blobs)
        common.release()

    parts, forget_parts = common.table_of(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(mine, "ids array<long>, a long, final boolean"))
    summed = parts.filter("NOT final").groupBy("ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    out, _ = common.table_of(parts.filter("final").select("ids", "a").unionByName(summed))
    forget_parts()
    forget_blocks()
    return out, words


def collocations(df: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and text.

    A phrase occurs a times within pieces, cut after its first k words into parts of l and r; its score is that of the
    lowest-scoring cut, floor(1000000 a a / (l r)), in decimals of 38 digits. A phrase goes if ``covered`` percent of its
    occurrences or more lie in one longer candidate. n: all words of the language. Null languages are ``und``, null
    texts empty; a text of any length is read whole; repeated rows count again; an empty table gives an empty one.
    """
    found, words = phrases(df, longest, least, **options)
    known = found.unionByName(words.filter("id IS NOT NULL").select(F.array("id").alias("ids"), F.col("f").alias("a")))
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr(SCORE.format(a="a", l="l", r="r"))
    scored = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # all shorter stretches of a candidate, each with the most frequent candidate that holds it
    inner = found.filter(F.size("ids") > 2).select(F.col("a").alias("b"), F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))")).alias("ids"))
    held = inner.groupBy("ids").agg(F.max("b").alias("b"))
    left = scored.join(held, "ids", "left").filter(F.col("b").isNull() | (F.col("b").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    spelt = left.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id").groupBy("ids").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    named = left.join(spelt, "ids").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the first of each language are among the first of its parts, so that one task ranks PARTS * top rows at most
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    parts = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", place("lang", "part")).filter(F.col("rank") <= top)
    first = parts.withColumn("rank", place("lang")).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

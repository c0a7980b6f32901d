"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text, scored by sharded joins."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 5
#: Bytes of input files for each block of documents, and for each shard of the model.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 64 << 20
#: Text bytes whose windows are held at once.
SLICE_BYTES = 1 << 20
#: Contexts of a sample of documents for each shard, from which the shards' edges are taken.
EDGE_SAMPLE = 64
PAD = "\x02"


def fold(text: str | None) -> str:
    """Lower case with white space folded; the padding character is left out."""
    return " ".join((text or "").replace(PAD, "").lower().split())


def codes(text: str, order: int = ORDER) -> np.ndarray:
    return np.frombuffer((PAD * (order - 1) + text).encode("utf-32-le", "surrogatepass"), "<u4")


def _windows(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, number of the gram at each position, positions of each text) of folded texts."""
    parts = [codes(t, order) for t in texts]
    sizes = np.array([max(0, len(p) - order + 1) for p in parts], np.int64)
    if not sizes.sum():
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int32), sizes
    flat = np.concatenate(parts)
    start = np.cumsum([0, *[len(p) for p in parts]])[:-1]
    inside = np.zeros(len(flat) - order + 2, np.int32)
    some = sizes > 0
    np.add.at(inside, start[some], 1)
    np.add.at(inside, start[some] + sizes[some], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    first, inverse = _distinct(flat, at, order)
    return np.lib.stride_tricks.sliding_window_view(flat, order)[at[first]], inverse, sizes


#: Entries of a presence table; beyond, distinct pairs are found by sorting.
DENSE = 1 << 22


def _distinct(flat: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct window among ``at``, number of the window at each place).

    Windows are numbered character by character: the pairs of the number so far and the next character are marked in
    a table, whose running count numbers the pairs that occur. No sort is needed while the table stays small.
    """
    present = np.zeros(int(flat.max()) + 1, bool)
    present[flat] = True
    letters = (np.cumsum(present) - 1)[flat]
    size = int(present.sum())
    number, count = letters[at], size
    for i in range(1, order):
        pair = number * size + letters[at + i]
        if count * size <= DENSE:
            table = np.zeros(count * size, bool)
            table[pair] = True
            rank = np.cumsum(table, dtype=np.int32) - 1
            number, count = rank[pair].astype(np.int64), int(rank[-1]) + 1
        else:
            found, number = np.unique(pair, return_inverse=True)
            count = len(found)
    first = np.zeros(count, np.int64)
    first[number] = np.arange(len(number))
    return first, number.astype(np.int32)


def _ordered(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in order, number of each row among them); rows: a gram's context reversed, then its last character."""
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    rows = np.concatenate([grams[:, -2::-1], grams[:, -1:]], axis=1)
    letters = common.distinct(rows)
    if len(letters) ** rows.shape[1] < 1 << 63:
        number = np.zeros(len(rows), np.int64)
        for column in np.searchsorted(letters, rows).T:
            number = number * len(letters) + column
        _, first, inverse = np.unique(number, return_index=True, return_inverse=True)
        return rows[first], inverse
    found, inverse = np.unique(rows, axis=0, return_inverse=True)
    return found, inverse.ravel()


class _Grams:
    """The grams of a block of texts, cut into slices of bounded size: ``rows`` are its distinct ones in order."""

    def __init__(self, texts: list[str | None], order: int):
        self.slices, parts, held, size = [], [], [], 0
        for i, t in enumerate(texts):
            held.append(fold(t))
            size += len(held[-1])
            if size >= SLICE_BYTES or i == len(texts) - 1:
                grams, inverse, sizes = _windows(held, order)
                parts.append(grams)
                self.slices.append((len(grams), inverse, sizes))
                held, size = [], 0
        self.rows, self.number = _ordered(np.concatenate(parts) if parts else np.zeros((0, order), np.uint32))

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, sum of the values at them) of each text, of a value for each of ``rows``."""
        sizes, totals, at = [], [], 0
        for count, inverse, n in self.slices:
            total = np.zeros(len(n))
            some = np.flatnonzero(n)
            if len(some):
                total[some] = np.add.reduceat(values[self.number[at : at + count]][inverse], (np.cumsum(n) - n)[some])
            at += count
            sizes.append(n)
            totals.append(total)
        return (np.concatenate(sizes), np.concatenate(totals)) if sizes else (np.zeros(0, np.int64), np.zeros(0))


def _places(rows: np.ndarray) -> np.ndarray:
    """Rows of code points as byte strings that sort as they do."""
    flat = np.ascontiguousarray(rows.astype(">u4"))
    return flat.view(f"S{4 * rows.shape[1]}").ravel()


def _pack(planes: np.ndarray) -> bytes:
    """Rows of 32-bit numbers as compressed byte planes, column by column."""
    a = np.ascontiguousarray(planes)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unpack(blob: bytes, width: int, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(4 * width, -1).T).view(kind)


class _Shard:
    """Model rows of a range of contexts as a trie of reversed contexts, level by level in sorted arrays."""

    def __init__(self, probabilities: list[tuple[str, float]], backoffs: list[tuple[str, float]], order: int):
        self.order = order
        text = "".join(g for g, _ in probabilities) + "".join(g for g, _ in backoffs)
        self.letters = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        self.size = len(self.letters) + 1
        known = {k: self._rows([x for x in probabilities if len(x[0]) == k], k) for k in range(1, order + 1)}
        back = {k: self._rows([x for x in backoffs if len(x[0]) == k], k) for k in range(1, order)}
        paths = {("p", k): m[:, -2::-1] if k > 1 else m[:, :0] for k, (m, _) in known.items()} | {("b", k): m[:, ::-1] for k, (m, _) in back.items()}
        nodes = {x: np.zeros(len(m), np.int64) for x, m in paths.items()}
        self.levels = []
        for depth in range(order - 1):
            deep = [x for x, m in paths.items() if m.shape[1] > depth]
            made = {x: nodes[x] * self.size + paths[x][:, depth] for x in deep}
            level = common.distinct(np.concatenate(list(made.values())))
            self.levels.append(level)
            nodes |= {x: np.searchsorted(level, v) for x, v in made.items()}
        self.backoff = [np.full(len(v), 0.0) for v in self.levels]
        for k, (_, v) in back.items():
            self.backoff[k - 1][nodes["b", k]] = v
        self.known = []
        for k, (m, v) in known.items():
            code = nodes["p", k] * self.size + m[:, -1]
            by = np.argsort(code)
            self.known.append((code[by], v[by]))

    def _rows(self, found: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer("".join(g for g, _ in found).encode("utf-32-le", "surrogatepass"), "<u4")
        return np.searchsorted(self.letters, flat).reshape(-1, k), np.array([v for _, v in found], np.float64)

    def log_probabilities(self, rows: np.ndarray, unseen: float) -> np.ndarray:
        """Of each row's last character after its context: the longest known gram, or back-off weights down to it."""
        at = np.searchsorted(self.letters, rows)
        there = np.minimum(at, max(0, len(self.letters) - 1))
        # a character that no row has takes the number beyond all
        index = np.where(self.letters[there] == rows, at, self.size - 1) if len(self.letters) else np.zeros(rows.shape, np.int64)
        node, lost, last = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), index[:, -1]
        lp = np.full(len(rows), unseen)
        for k, (codes_, values) in enumerate(self.known):
            if k:
                node, hit = _find(self.levels[k - 1], node * self.size + index[:, k - 1])
                lost |= ~hit
                back = self.backoff[k - 1][node] if len(self.backoff[k - 1]) else np.zeros(len(rows))
                lp = lp + np.where(lost, 0.0, back)
            place, hit = _find(codes_, node * self.size + last)
            if len(values):
                lp = np.where(hit & ~lost, values[place], lp)
        return lp


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def count_grams(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(gram, a) over all texts; counts are folded in each slice of a task before their shuffle."""

    common.ship(docs)

    def run(batches):
        for whole in batches:
            for b in common.text_slices(whole, 0, SLICE_BYTES):
                grams, inverse, _ = _windows([fold(t) for t in b.column(0).to_pylist()], order)
                yield from _gram_rows(grams, np.bincount(inverse, minlength=len(grams))).to_batches()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("a"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many grams were seen once to four times; each stays between 0 and its count."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(float(i), max(0.0, d)) for i, d in enumerate(raw, 1))  # type: ignore[return-value]


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text", counts: DataFrame | None = None) -> tuple[DataFrame, float]:
    """((gram, logp, bow), log probability of an unseen character): probabilities of all seen grams, back-off weights of contexts.

    The highest order uses counts, lower orders the number of different characters on the left. Every table is keyed
    by the gram's text, so all joins are equi-joins sharded by it, and none grows beyond the distinct grams.
    ``counts``: (gram, a) of the texts, counted already.
    """
    counted, forget = common.table_of(count_grams(docs, order, text_col) if counts is None else counts)
    adjusted = {order: counted}
    for k in range(order - 1, 0, -1):
        adjusted[k] = common.checkpoint(adjusted[k + 1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("a")))
    lower, model, unseen = None, None, math.log(1e-6)
    weights = {}
    for k in range(1, order + 1):
        a = adjusted[k]
        row = a.agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.lit(1)).alias("v")).first()
        d1, d2, d3 = discounts([row[f"n{i}"] for i in (1, 2, 3, 4)])
        context = F.expr(f"substring(gram, 1, {k - 1})").alias("h")
        h = a.groupBy(context).agg(F.sum("a").alias("tot"), ((d1 * F.count_if(F.col("a") == 1) + d2 * F.count_if(F.col("a") == 2) + d3 * F.count_if(F.col("a") >= 3)) / F.sum("a")).alias("gamma"))
        weights[k] = h
        left = F.col("a") - F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        if k == 1:
            g = h.first()
            if g is None:
                return docs.sparkSession.createDataFrame([], "gram string, logp double, bow double"), unseen
            unseen = math.log(max(1e-12, g["gamma"]) / (row["v"] + 1))
            p = a.select("gram", (left / g["tot"] + g["gamma"] / (row["v"] + 1)).alias("p"))
        else:
            suffix = F.expr(f"substring(gram, 2, {k - 1})")
            low = lower.select(F.col("gram").alias("s"), F.col("p").alias("low"))
            p = a.withColumn("h", context).join(h, "h").withColumn("s", suffix).join(low, "s").select("gram", (left / F.col("tot") + F.col("gamma") * F.col("low")).alias("p"))
        lower = common.checkpoint(p)
        if k > 1:
            # back-off weights of order k belong to grams of order k - 1; contexts that are padding only have no probability
            bow = weights[k].select(F.col("h").alias("gram"), F.ln("gamma").alias("bow"))
            model = model.join(bow, "gram", "full") if k == 2 else model.unionByName(last.join(bow, "gram", "full"))
        last = lower.select("gram", F.ln("p").alias("logp"))
        if k == 1:
            model = last
    model = common.checkpoint(model.unionByName(last.withColumn("bow", F.lit(None).cast("double"))))
    forget()
    return model, unseen


def _block(df: DataFrame, id_col: str, blocks: int, text_col: str | None = None):
    """Block of a row by its id; rows without one are dealt by their text."""
    key = F.col(id_col).cast("string")
    text = F.when(F.col(id_col).isNull(), F.col(text_col).cast("string")) if text_col else F.lit(None).cast("string")
    return F.pmod(F.xxhash64(key, text, F.lit(7)), F.lit(blocks)).cast("int")


def _dealt(df: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """(__block, packed): documents as compressed Arrow streams of (keep, __text, __block), dealt to blocks by one shuffle."""
    width, blocks = len(keep), common.parts_for(df, BLOCK_BYTES, text_col=text_col)

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for b in common.text_slices(whole, width, 16 << 20):
                number = b.column(width + 1).to_numpy()
                by = np.argsort(number, kind="stable")
                ends = np.flatnonzero(np.diff(number[by], append=-1)) + 1
                rows, start = [], 0
                for end in ends.tolist():
                    sink = pa.BufferOutputStream()
                    part = b.take(pa.array(by[start:end]))
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    rows.append((int(number[by[start]]), squeeze(sink.getvalue().to_pybytes())))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["__block", "packed"])
        common.release()

    src = df.select(*[df[f"`{c}`"] for c in keep], F.col(text_col).cast("string").alias("__text"), _block(df, id_col, blocks, text_col).alias("__block"))
    return src.mapInArrow(pack, "__block int, packed binary").repartition(blocks, "__block")


def _unpacked(t: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all() for x in t.column("packed").to_pylist())


def _gram_rows(grams: np.ndarray, n: np.ndarray) -> pa.Table:
    order = grams.shape[1]
    text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.table({"gram": pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()), "n": pa.array(n, pa.int64())})


def count_trusted(df: DataFrame, ids: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, a) over the texts of rows whose id is in ``ids`` (one column), counted where the documents are dealt.

    Ids travel to their block instead of texts to a join, so that the amount moved does not depend on how many there are.
    """
    common.ship(df)
    blocks = common.parts_for(df, BLOCK_BYTES, text_col=text_col)
    name = ids.columns[0]
    wanted = ids.select(F.col(name).alias("__good"), _block(ids, name, blocks).alias("__b")).repartition(blocks, "__b")

    def run(t: pa.Table, good: pa.Table) -> pa.Table:
        known = set(good.column("__good").to_pylist())
        if not t.num_rows or not known:
            return _gram_rows(np.zeros((0, order), np.uint32), np.zeros(0, np.int64))
        t = _unpacked(t)
        some = [x for i, x in zip(t.column(id_col).to_pylist(), t.column("__text").to_pylist(), strict=True) if i in known]
        grams = _Grams(some, order)
        n = np.zeros(len(grams.rows), np.int64)
        at = 0
        for count, inverse, _ in grams.slices:
            n += np.bincount(grams.number[at : at + count][inverse], minlength=len(n)) if len(inverse) else 0
            at += count
        rows = np.concatenate([grams.rows[:, -2::-1], grams.rows[:, -1:]], axis=1)
        out = _gram_rows(rows, n)
        del t, some, grams, rows
        common.release()
        return out

    placed = _dealt(df, [id_col], id_col, text_col)
    found = placed.groupBy("__block").cogroup(wanted.groupBy("__b")).applyInArrow(run, "gram string, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("a"))


def _edges(df: DataFrame, shards: int, order: int, id_col: str, text_col: str) -> np.ndarray:
    """Contexts that cut the reversed contexts of a sample of documents into ``shards`` ranges of about one size.

    Like the bounds of a range partitioning they are one short string for each shard, and only balance the shards.
    """
    if shards < 2:
        return np.zeros(0, f"S{4 * (order - 1)}")
    step = max(1, df.count() // (4 * shards + 200))
    some = df.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(step)) == 0).select(F.col(text_col).cast("string"))

    def run(batches):
        for b in batches:
            rows = _Grams(b.column(0).to_pylist(), order).rows
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(rows[:, :-1])).tolist(), pa.binary())], names=["place"])

    found = some.mapInArrow(run, "place binary").distinct().orderBy(F.xxhash64("place"), "place").limit(EDGE_SAMPLE * shards).collect()
    places = np.unique(np.array([bytes(r[0]).ljust(4 * (order - 1), b"\0") for r in found], f"S{4 * (order - 1)}"))
    return np.unique(places[[len(places) * i // shards for i in range(1, shards)]]) if len(places) >= shards else places


def perplexities(df: DataFrame, model: DataFrame, unseen: float, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_scored`` (characters) and ``perplexity`` to each row; null where no character is left.

    Documents are packed by block, compressed, and dealt out by one shuffle. A block sends its distinct grams, sorted
    by reversed context, to the shards of the model, each a range of such contexts. Every shorter context of a gram is
    a prefix of its own, so that rows of a short context need copies only in the shards that its range meets, and a
    shard answers for a gram by itself: joined, counted and backed off, one 32-bit number for each. Grams travel as
    they are, not as hashes. A block and a shard exchange one message at most, and never more than grams asked for.
    Each worker holds a block's text (about 7 MB), the windows of 1 MB of it, or one shard's part of the model.
    """
    common.ship(df)
    keep = common.without(df, ["n_scored", "perplexity"]) if keep is None else keep
    edges = _edges(df, common.parts_for(df, SHARD_BYTES, text_col=text_col), order, id_col, text_col)
    shards = len(edges) + 1
    placed = _dealt(df, keep, id_col, text_col)

    def cuts(rows: np.ndarray) -> list[int]:
        return [0, *np.searchsorted(_places(rows[:, :-1]), edges).tolist(), len(rows)]

    def emit(t: pa.Table) -> pa.Table:
        t = _unpacked(t)
        rows = _Grams(t.column("__text").to_pylist(), order).rows
        some = [(s, a, b) for s, (a, b) in enumerate(pairwise(cuts(rows))) if b > a]
        n = t.column("__block")[0].as_py()
        out = pa.table({"shard": pa.array([s for s, _, _ in some], pa.int32()), "block": pa.array([n] * len(some), pa.int32()), "asked": pa.array([_pack(rows[a:b].astype("<u4")) for _, a, b in some], pa.binary())})
        del t, rows
        common.release()
        return out

    def shard_model(batches):
        """A row for each shard whose range of contexts meets that of the row's."""
        full = 4 * (order - 1)
        for b in batches:
            gram, role, value = (c.to_pylist() for c in b.columns)
            context = [(g if r == "b" else g[:-1])[::-1].encode("utf-32-be", "surrogatepass") for g, r in zip(gram, role, strict=True)]
            low = np.searchsorted(edges, np.array([c.ljust(full, b"\0") for c in context], f"S{full}"), side="right")
            high = np.searchsorted(edges, np.array([c.ljust(full, b"\xff") for c in context], f"S{full}"), side="right")
            n = high - low + 1
            row = np.repeat(np.arange(len(gram)), n)
            shard = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)).astype(np.int32)
            for at in range(0, len(row), 10_000):
                i = pa.array(row[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 10_000]), *(c.take(i) for c in b.columns)], names=["m_shard", "gram", "role", "value"])

    def resolve(asked: pa.Table, known: pa.Table) -> pa.Table:
        found = {"p": [], "b": []}
        for g, r, v in zip(*[known.column(c).to_pylist() for c in ("gram", "role", "value")], strict=True):
            found[r].append((g, v))
        model_rows = _Shard(found["p"], found["b"], order)
        del found
        rows = {"__block": asked.column("block"), "shard": asked.column("shard"), "logp": []}
        for blob in asked.column("asked"):
            rows["logp"].append(_pack(model_rows.log_probabilities(_unpack(blob.as_py(), order, "<u4"), unseen).astype("<f4")[:, None]))
        return pa.table(rows | {"logp": pa.array(rows["logp"], pa.binary())})

    def add_up(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = _unpacked(t)
        grams = _Grams(t.column("__text").to_pylist(), order)
        lp = np.full(len(grams.rows), np.nan)
        at = cuts(grams.rows)
        for s, blob in zip(answers.column("shard").to_pylist(), answers.column("logp").to_pylist(), strict=True):
            lp[at[s] : at[s + 1]] = _unpack(blob, 1, "<f4").ravel()
        sizes, total = grams.sums(lp)
        ppl = [math.exp(min(700.0, -x / n)) if n else None for x, n in zip(total.tolist(), sizes.tolist(), strict=True)]
        out = pa.table({c: t.column(c) for c in keep} | {"n_scored": pa.array(sizes, pa.int64()), "perplexity": pa.array(ppl, pa.float64())})
        del t, grams, lp
        common.release()
        return out

    sent = placed.groupBy("__block").applyInArrow(emit, "shard int, block int, asked binary")
    rows = model.select("gram", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("value")) for r, c in (("p", "logp"), ("b", "bow"))])).alias("x"))
    rows = rows.select("gram", "x.role", "x.value").filter("value IS NOT NULL")
    sharded = rows.mapInArrow(shard_model, "m_shard int, gram string, role string, value double")
    answers = sent.repartition(shards, "shard").groupBy("shard").cogroup(sharded.repartition(shards, "m_shard").groupBy("m_shard")).applyInArrow(resolve, "__block int, shard int, logp binary")
    types = {f.name: f for f in df.schema.fields}
    out = T.StructType([types[c] for c in keep] + [T.StructField("n_scored", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return placed.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(add_up, out)


def classify(df: DataFrame, trusted: DataFrame, quantile: float = 0.995, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_scored, perplexity, threshold, keep) for each row.

    ``trusted``: one column of ids whose texts are good. Four fifths of them (by hash) train the model; the others set
    each language's threshold, the ``quantile`` of their perplexity, so that text the model has not seen is judged by
    text it has not seen. A language without such texts gets the threshold of all of them; without any, every row
    is kept. Rows of a null or blank text have no perplexity and are not kept. Repeated rows and ids are each scored,
    equal texts alike; ties with a threshold are kept. A null id is no trusted one. A text of any length is scored
    whole, in one worker. An empty table gives an empty one. Columns beyond those named are left aside, so that names
    such as ``keep`` or ``perplexity`` in the input do not clash.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("__good")).filter("__good IS NOT NULL").distinct()
    train_on = F.pmod(F.xxhash64(F.col("__good"), F.lit(11)), F.lit(5)) != 0
    src = df.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("text"))
    model, unseen = train(src, order, counts=count_trusted(src, ids.filter(train_on), order, "__id", "text"))
    scored = common.checkpoint(perplexities(src, model, unseen, order, "__id", "text", ["__id", "__lang"]))
    held = scored.join(ids.filter(~train_on), F.col("__id") == F.col("__good"), "left_semi").filter("perplexity IS NOT NULL")
    cut = held.groupBy("__lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    whole = held.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("all")).first()["all"]
    cut = cut.select(F.col("__lang").alias("l"), "own")
    out = scored.join(cut, F.col("__lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("own", F.lit(whole).cast("double")))
    keep = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select(F.col("__id").alias(id_col), F.col("__lang").alias(lang_col), "n_scored", "perplexity", "threshold", keep.alias("keep"))

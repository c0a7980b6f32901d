"""Substring dedup: confirm recurring passages, compile sharded Aho-Corasick automata, stream all documents through."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 20
#: Bytes of input files for each block of documents, and for each shard of window hashes or passages.
BLOCK_BYTES = 3 << 20
SHARD_BYTES = 4 << 20
#: Words of passages in one automaton, and words that are told apart by one character each.
AUTOMATON_WORDS = 250_000
ALPHABET = 1_000_000
#: Words of the run whose least hash tells the shard of a window.
ANCHOR = 5
#: Bits of a window's hash beyond those that number all windows: of so many powers of two one window is asked in vain.
SPARE_BITS = 7
#: Bytes of text whose prefix sums are held at once.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_grown: dict[int, np.ndarray] = {}
common.CACHES.append(_grown.clear)


def _powers(base: int, n: int) -> np.ndarray:
    got = _grown.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 4 * PIECE:
            _grown[base] = got
    return got[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of a sequence of word hashes, from prefix sums modulo 2^64."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, n), out=total[1:])
    return _mixed((total[width:] - total[:-width]) * _powers(_INVERSE, n - width + 1))


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of ``buf``, which ends with white space, piece by piece."""
    starts, ends, hashes, at = [], [], [], 0
    a = np.frombuffer(buf, np.uint8)
    while at < len(a):
        to = min(len(a), at + PIECE)
        while to < len(a) and not _SPACE[a[to - 1]]:
            # a word is not cut: the piece grows to the next white space
            more = np.flatnonzero(_SPACE[a[to : to + PIECE]])
            to = to + int(more[0]) + 1 if len(more) else min(len(a), to + PIECE)
        part = a[at:to]
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[part]].astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + _U(1)) * _powers(_BASE, len(part)), out=total[1:])
        h = (total[e] - total[s]) * _powers(_INVERSE, len(part))[s] if len(s) else np.zeros(0, np.uint64)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(_mixed(h + (e - s).astype(np.uint64)))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, so that their leading zeros compress away."""
    d = np.diff(h, prepend=_U(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _squeeze(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _numbers(blob: bytes, kind: str, width: int = 1) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).reshape(-1, width)


def _ranked(table: pa.Table, id_col: str, text_col: str) -> list[int]:
    """Rows of a block in order: null ids last, rows that repeat an id by their text."""
    ids, texts = table.column(id_col).to_pylist(), table.column(text_col).to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class _Block:
    """Documents of a block in order, the places and hashes of their words and their windows' hashes."""

    def __init__(self, table: pa.Table, width: int, bits: int):
        self.width, texts = width, table.column("__text")
        self.order = _ranked(table, "__id", "__text")
        ids = table.column("__id").to_pylist()
        self.ids = [ids[i] for i in self.order]
        raw = [_raw(texts[i].as_py()) for i in self.order]
        self.buf = b"\n".join([*raw, b""])
        begin = np.cumsum([0, *[len(r) + 1 for r in raw]])[:-1]
        self.starts, self.ends, self.words = word_spans(self.buf)
        #: number of the first word of each document, and beyond the last
        self.first = np.r_[np.searchsorted(self.starts, begin), len(self.starts)]
        room = np.diff(self.first)
        doc = np.repeat(np.arange(len(room)), room)
        #: words at which a window of one document starts
        self.at = np.flatnonzero(np.arange(len(doc)) + width <= self.first[doc + 1])
        self.doc = doc
        self.hashes = window_hashes(self.words, width)[self.at] >> _U(64 - bits)

    def segments(self, candidate: np.ndarray) -> list[tuple[int, int, int]]:
        """(anchor, first word, number of windows) of each run of candidate windows with one anchor.

        The anchor of a window is the least hash of its runs of ``ANCHOR`` words, which depends on its words alone.
        """
        size = min(ANCHOR, self.width)
        at, runs = self.at[candidate], window_hashes(self.words, size)
        if not len(at):
            return []
        place = np.empty(len(at), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(runs, self.width - size + 1)
        for i in range(0, len(at), 100_000):
            cut = at[i : i + 100_000]
            place[i : i + len(cut)] = cut + view[cut].argmin(axis=1)
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(place, prepend=-1) != 0) | (np.diff(self.doc[at], prepend=-1) != 0))
        return list(zip(runs[place[new]].tolist(), at[new].tolist(), np.diff(np.r_[new, len(at)]).tolist(), strict=True))


def _shard_edges(shards: int, bits: int = 64) -> np.ndarray:
    return np.array([-(-(i << bits) // shards) for i in range(1, shards)], np.uint64)


def _emit(shards: int, width: int, bits: int):
    edges = _shard_edges(shards, bits)

    def f(table: pa.Table) -> pa.Table:
        block = table.column("__block")[0].as_py()
        h = common.distinct(_Block(table, width, bits).hashes)
        cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
        some = [(s, a, b) for s, (a, b) in enumerate(pairwise(cuts)) if b > a]
        common.release()
        return pa.table(
            {
                "shard": pa.array([s for s, _, _ in some], pa.int32()),
                "block": pa.array([block] * len(some), pa.int32()),
                "hashes": pa.array([pack_sorted(h[a:b]) for _, a, b in some], pa.binary()),
            }
        )

    return f


def _resolve(table: pa.Table) -> pa.Table:
    """For each block's hashes of a shard, a bit for those that another block has too."""
    blocks, shard = table.column("block").to_pylist(), table.column("shard")[0].as_py()
    lists = [unpack_sorted(b.as_py()) for b in table.column("hashes")]
    h = np.concatenate(lists)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    out, at = [], 0
    for x in lists:
        out.append(_squeeze(np.packbits(again[at : at + len(x)])))
        at += len(x)
    return pa.table({"__block": pa.array(blocks, pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "seen": pa.array(out, pa.binary())})


def _send(shards: int, width: int, bits: int):
    """Candidate windows of a block as passages, dealt to shards; copies within the block travel once."""
    edges = _shard_edges(shards, bits)

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"shard": [], "block": [], "keys": [], "texts": [], "sizes": [], "places": [], "ids": []}
        if docs.num_rows:
            block, number = _Block(docs, width, bits), docs.column("__block")[0].as_py()
            unique, inverse, count = np.unique(block.hashes, return_inverse=True, return_counts=True)
            seen = count > 1
            cuts = [0, *np.searchsorted(unique, edges).tolist(), len(unique)]
            for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("seen").to_pylist(), strict=True):
                a, b = cuts[shard], cuts[shard + 1]
                seen[a:b] |= np.unpackbits(_numbers(blob, np.uint8).ravel(), count=b - a).astype(bool)
            found: dict[tuple[int, bytes], list[int]] = {}
            for key, word, n in block.segments(seen[inverse]):
                text = b" ".join(block.buf[block.starts[word] : block.ends[word + n + width - 2]].split())
                found.setdefault((key, text), []).append(word)
            by_shard: dict[int, list] = {}
            for (key, text), at in found.items():
                by_shard.setdefault(key % shards, []).append((key, text, at))
            for shard, some in by_shard.items():
                some.sort(key=lambda x: x[0])
                word = np.array([w for _, _, at in some for w in at])
                doc = block.doc[word]
                lead = block.doc[[at[0] for _, _, at in some]].tolist()
                rows["shard"].append(shard)
                rows["block"].append(number)
                rows["keys"].append(pack_sorted(np.array([k for k, _, _ in some], np.uint64)))
                rows["texts"].append(_squeeze(b"\n".join(t for _, t, _ in some)))
                rows["sizes"].append(_squeeze(np.array([len(at) for _, _, at in some], "<i4")))
                rows["places"].append(_squeeze(np.stack([doc, word - block.first[doc]], axis=1).astype("<i4")))
                rows["ids"].append(_squeeze(np.array([(block.ids[d] is None, block.ids[d] or 0) for d in lead], "<i8")))
            del block, unique, inverse, count, seen, found, by_shard
            common.release()
        return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "block") else pa.binary()) for k, v in rows.items()})

    return f


class _Letters(dict):
    """A character for each word, given out in the order of first use; surrogates are left out."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = c = chr(n if n < 0xD800 else n + 0x800)
        return c


def occurrences(docs: list[str], passages: list[str]) -> list[list[tuple[int, int]]]:
    """(start, number of the passage) of every occurrence in each document, found by automata; a word is a character.

    The passages are dealt to automata of bounded size; every document streams through each of them.
    """
    hits: list[list[tuple[int, int]]] = [[] for _ in docs]
    at = 0
    while at < len(passages):
        size, auto = 0, ahocorasick.Automaton()
        while at < len(passages) and (not size or size + len(passages[at]) <= AUTOMATON_WORDS):
            size += len(passages[at])
            auto.add_word(passages[at], (len(passages[at]) - 1, at))
            at += 1
        auto.make_automaton()
        for d, found in zip(docs, hits, strict=True):
            found += [(end - n, p) for end, (n, p) in auto.iter(d)]
    return hits


def _late(segments: list[bytes], width: int) -> list[list[int]]:
    """For each segment, in the order of the corpus: its windows whose words start earlier, confirmed word by word."""
    split = [s.split(b" ") for s in segments]
    letters, per = _Letters(), 1
    coded = ["".join(map(letters.__getitem__, w)) for w in split] if sum(map(len, split)) < ALPHABET else None
    if coded is None:
        # more words than characters, perhaps: a word is two, and occurrences start at even places
        number: dict[bytes, int] = {}
        per, pair = 2, lambda n: letters[n % ALPHABET] + letters[-1 - n // ALPHABET]
        coded = ["".join(pair(number.setdefault(w, len(number))) for w in words) for words in split]
    step = width * per
    seen = Counter([c[i : i + step] for c in coded for i in range(0, len(c) - step + 1, per)])
    passages = [k for k, n in seen.items() if n > 1]
    del seen, split
    first: set[int] = set()
    late = []
    for found in occurrences(coded, passages):
        mine = []
        for start, p in sorted(found):
            if start % per == 0:
                if p in first:
                    mine.append(start // per)
                else:
                    first.add(p)
        late.append(mine)
    return late


def _confirm(width: int):
    """For each block, the words (document, from, to) that go, of the passages of a shard."""

    def f(table: pa.Table) -> pa.Table:
        keys, texts, order, places = [], [], [], []
        for m in table.to_pylist():
            keys += unpack_sorted(m["keys"]).tolist()
            texts += zstandard.ZstdDecompressor().decompress(m["texts"]).split(b"\n")
            where = _numbers(m["places"], "<i4", 2)
            ends = np.cumsum(_numbers(m["sizes"], "<i4").ravel()).tolist()
            for a, b, (none, i) in zip([0, *ends], ends, _numbers(m["ids"], "<i8", 2).tolist(), strict=False):
                places.append(where[a:b])
                order.append((none, i, m["block"], *where[a].tolist()))
        by = sorted(range(len(keys)), key=lambda i: keys[i])
        gone: dict[int, list[np.ndarray]] = {}

        def close(some: list[int]) -> None:
            some.sort(key=order.__getitem__)
            for i, late in zip(some, _late([texts[i] for i in some], width), strict=True):
                where, block = places[i], order[i][2]
                if late:
                    at = np.array(late) + where[0, 1]
                    gone.setdefault(block, []).append(np.stack([np.full(len(at), where[0, 0]), at, at + width], axis=1))
                if len(where) > 1:
                    n = texts[i].count(b" ") + 1
                    gone.setdefault(block, []).append(np.column_stack([where[1:], where[1:, 1] + n]))

        # windows of different anchors differ: a run of whole anchors fills an automaton
        group, size = [], 0
        for j, i in enumerate(by):
            group.append(i)
            size += width * (texts[i].count(b" ") + 2 - width)
            if size >= AUTOMATON_WORDS and (j + 1 == len(by) or keys[by[j + 1]] != keys[i]):
                close(group)
                group, size = [], 0
        if group:
            close(group)
        out = {b: np.concatenate(v).astype("<i4") for b, v in gone.items()}
        rows = pa.table({"__block": pa.array(list(out), pa.int32()), "gone": pa.array([_squeeze(v) for v in out.values()], pa.binary())})
        del keys, texts, order, places, gone
        common.release()
        return rows

    return f


def _apply(keep: list[str], text: str):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = _ranked(docs, "__id", text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for blob in answers.column("gone").to_pylist():
            for d, a, b in _numbers(blob, "<i4", 3).tolist():
                spans.setdefault(d, []).append((a, b))
        n_words, n_removed, kept = ([None] * len(order) for _ in range(3))
        texts = docs.column(text)
        for d, i in enumerate(order):
            raw = _raw(texts[i].as_py()).split()
            n_words[i] = len(raw)
            if d in spans:
                gone = np.zeros(len(raw) + 1, np.int32)
                at = np.array(spans[d])
                np.add.at(gone, at[:, 0], 1)
                np.add.at(gone, at[:, 1], -1)
                stay = np.cumsum(gone[:-1]) == 0
                raw = [w for w, x in zip(raw, stay.tolist(), strict=True) if x]
            n_removed[i] = n_words[i] - len(raw)
            kept[i] = b" ".join(raw).decode("utf-8", "surrogatepass")
        out = pa.table({k: docs.column(k) for k in keep} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})
        del kept, spans
        common.release()
        return out

    return f


def remove_repeats(df: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by spaces) to each row.

    A word goes when a window of ``width`` words covers it whose words also start earlier: in a smaller id, or before
    it in the same document. Ids are whole numbers; rows with a null id come last, in an order of their texts that
    reruns repeat; rows that repeat an id are ordered by text, and equal rows each count as a document. A null or empty text
    has no words. A text of any length is taken whole, in one worker. An empty table gives an empty one. Input columns
    with the outputs' names are replaced. Windows are judged on the input.

    Plan: documents are dealt to blocks by one shuffle. Each block sends its distinct window hashes, just long enough
    to tell the corpus' windows apart, sorted and packed, to shards; a shard answers with a bit for each hash that
    another block has. Windows so marked, or that recur in the block, are only candidates. Runs of them travel as
    words, once for each block, to the shard of their anchor, the least hash of five words within a window, so that
    equal windows always meet. There, windows whose words recur are confirmed and compiled into Aho-Corasick automata
    of bounded size; all candidate passages stream through, and each occurrence but the first goes. So words decide, never hashes.
    A passage that all documents share is one row for each block; a block and a shard exchange at most one row, and
    never more rows than windows.
    """
    common.ship(df)
    names = ["n_words", "n_removed", "kept"]
    keep = common.without(df, names) if keep is None else keep
    # the text travels once where it is among the columns to return
    text = text_col if text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType) else "__text"
    cols = [df[f"`{c}`"] for c in keep] + ([] if text == text_col else [F.col(text_col).cast("string").alias("__text")])
    blocks, shards = common.parts_for(df, BLOCK_BYTES, text_col=text_col), common.parts_for(df, SHARD_BYTES, text_col=text_col)
    bits = max(1, min(63, 20 + (blocks - 1).bit_length() + SPARE_BITS))
    # rows that repeat an id meet; those without one are dealt by their text
    block = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col))), F.lit(blocks)).cast("int")
    placed = df.select(*cols, F.col(id_col).cast("long").alias("__id"), block.alias("__block")).repartition(blocks, "__block")
    words = placed.select("__block", "__id", F.col(f"`{text}`").alias("__text"))
    sent = words.groupBy("__block").applyInArrow(_emit(shards, width, bits), "shard int, block int, hashes binary")
    seen = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_resolve, "__block int, shard int, seen binary")
    passages = words.groupBy("__block").cogroup(seen.groupBy("__block")).applyInArrow(_send(shards, width, bits), "shard int, block int, keys binary, texts binary, sizes binary, places binary, ids binary")
    gone = passages.repartition(shards, "shard").groupBy("shard").applyInArrow(_confirm(width), "__block int, gone binary")
    types = {f.name: f for f in df.schema.fields}
    out = T.StructType([types[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return placed.groupBy("__block").cogroup(gone.groupBy("__block")).applyInArrow(_apply(keep, text), out)


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

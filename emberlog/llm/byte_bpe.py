"""Byte-level BPE by ranks: long texts are cut into overlapping chunks, stitched where their pre-token boundaries meet.

A chunk is pre-tokenised and encoded wherever it lands. Its first boundaries can be wrong, because it may begin inside
a pre-token; but whether a pre-token ends at a place depends only on where it begins and on the text from there, so
that two chunks that share one boundary share all later ones. Neighbours overlap by enough text to hold such a place,
and each pre-token is taken from one of them. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import contextlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, token_count
from .bpe import merge

#: Characters of a chunk before its overlap with the next one, and least characters of the overlap.
CHUNK, OVERLAP = 32_768, 512


@lru_cache(maxsize=1)
def classes() -> dict[str, list[tuple[int, int]]]:
    """Character classes as ranges of code points: L letters, N numbers, S white space.

    They are read from the library itself, because Unicode versions differ: with a rank for each byte and a class as its
    pattern it keeps the characters of the class alone.
    """
    points = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
    every = "".join(map(chr, points))
    single = {bytes([b]): b for b in range(256)}
    got = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        own = tiktoken.Encoding(f"class {name}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = np.array([ord(c) for c in bytes(own.encode_ordinary(every)).decode()])
        first = np.r_[True, np.diff(found) != 1]
        got[name] = list(zip(found[first].tolist(), found[np.r_[first[1:], True]].tolist(), strict=True))
    return got


#: Largest code points of the texts that a pattern serves: Python tries the ranges of a class beyond 0xFFFF one by one.
PLANES = (0x7F, 0xFFFF, sys.maxunicode)


def spelled(pattern: str) -> tuple[str, ...]:
    """A pattern for Python's own engine, one for each of ``PLANES``: the classes as ranges of code points."""
    got = []
    for most in PLANES:
        own = {k: "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in v if a <= most) for k, v in classes().items()}
        out, brackets = [], 0
        for part in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.DOTALL):
            brackets += (part == "[") - (part == "]")
            name = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "S", r"\S": "S"}.get(part)
            out.append(part if name is None else own[name] if brackets else f"[{'^' * (part == r'\S')}{own[name]}]")
        got.append("".join(out))
    return tuple(got)


class Ranks:
    """Byte strings by rank, and the merges that they imply."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.strings = [b""] * (max(self.ranks.values()) + 1)
        for s, i in self.ranks.items():
            self.strings[i] = s
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        #: (left id, right id) -> (rank, id of both): a string's rank is its id, and any two halves of it make it
        self.pairs = {}
        for s, i in self.ranks.items():
            for k in range(1, len(s)):
                a, b = self.ranks.get(s[:k]), self.ranks.get(s[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (i, i)


class Merger(token_count.Merger):
    """Merges many short pre-tokens at once, one merge for each of them in a round."""

    def __init__(self, model: Ranks):
        pairs = sorted(((a << 20) | b, i) for (a, b), (i, _) in model.pairs.items())
        keys, ids = zip(*pairs, strict=True)
        self._keys, self._ranks, self._both = np.array(keys, np.int64), np.array(ids, np.int64), np.array(ids, np.int64)
        self._first = np.array(model.single, np.int64)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: in every round the leftmost pair of least rank of each piece is merged."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self._first[np.frombuffer(b"".join(pieces), np.uint8)]
        who = np.repeat(np.arange(len(pieces)), lens)
        rank, both = np.full(len(sym), self.NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], both[:-1] = self._rank(sym[:-1], sym[1:])
            rank[:-1][who[:-1] != who[1:]] = self.NONE
        ended = []
        while len(sym):
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            open_ = np.repeat(least != self.NONE, size)
            ended.append((who[~open_], sym[~open_]))
            at = np.flatnonzero((rank == np.repeat(least, size)) & open_)
            at = at[np.r_[True, who[at][1:] != who[at][:-1]]] if len(at) else at
            sym[at] = both[at]
            open_[at + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[at] = True
            # the pair on the left of each merge and the pair that it now begins have new ranks
            moved[at[at > 0] - 1] = True
            sym, who, rank, both, moved = sym[open_], who[open_], rank[open_], both[open_], moved[open_]
            new = np.flatnonzero(moved)
            last = new == len(sym) - 1
            inner = new[~last]
            rank[new[last]] = self.NONE
            rank[inner], both[inner] = self._rank(sym[inner], sym[inner + 1])
            rank[inner[who[inner] != who[inner + 1]]] = self.NONE
        if not ended:
            return [b""] * len(pieces)
        who, sym = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(who, kind="stable")
        raw = sym[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(who, minlength=len(pieces)))).tolist()
        return [raw[a:b] for a, b in pairwise([0, *ends])]


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(load(path))


class Codec:
    """Encoder and decoder of one rank file and one pattern, whose classes are written out (``spelled``).

    Pre-tokens that are strings of the file are found in a table; the others of many texts are merged together and
    stay in the table until it holds ``ENTRIES`` of them.
    """

    ENTRIES, LONG = 400_000, 64

    def __init__(self, path: str, patterns: tuple[str, ...]):
        self.model = load(path)
        self._ascii, self._basic, self._full = (re.compile(p).findall for p in patterns)
        self._merger = _merger(path)
        self._whole = {}
        for raw, i in self.model.ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self._whole[raw.decode()] = i.to_bytes(4, "little")
        self._table = dict(self._whole)

    def _pieces(self, text: str) -> list[str]:
        find = self._ascii if text.isascii() else self._full if _ASTRAL.search(text) else self._basic
        return find(text)

    def _merged(self, pieces: list[str]) -> list[bytes]:
        m = self.model
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = iter(self._merger.ids([r for r in raw if len(r) <= self.LONG]))
        return [next(short) if len(r) <= self.LONG else np.array(merge([m.single[b] for b in r], m.pairs), "<u4").tobytes() for r in raw]

    def encode_all(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """Pre-tokens of each text and the ids of each, as little-endian unsigned 32-bit integers."""
        cut = list(map(self._pieces, texts))
        if len(self._table) > self.ENTRIES + len(self._whole):
            self._table = dict(self._whole)
        table = self._table
        new = list(set().union(*cut).difference(table))
        table.update(zip(new, self._merged(new), strict=True))
        return [(pieces, list(map(table.__getitem__, pieces))) for pieces in cut]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        return [b"".join(ids) for _, ids in self.encode_all(texts)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], "<u4").tolist()

    def chunks(self, texts: list[str], last: list[bool]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
        """(boundaries, ids before each boundary, ids) of each chunk: characters from its start, and ids as bytes.

        The last pre-token of a chunk that another follows may go on in the text beyond, and is left to that one.
        """
        out = []
        for (pieces, ids), end in zip(self.encode_all(texts), last, strict=True):
            pieces, ids = (pieces, ids) if end else (pieces[:-1], ids[:-1])
            out.append((np.cumsum([0, *map(len, pieces)]), np.cumsum([0, *map(len, ids)]) // 4, b"".join(ids)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.model.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=2)
def _codec(path: str, patterns: tuple[str, ...]) -> Codec:
    return Codec(path, patterns)


def chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, next chunk's start or -1) of the chunks of a text; ``chunk`` is longer than ``overlap`` by 3 or more.

    A pre-token never holds a visible character and white space after it: there both chunks have a boundary, whatever
    they begin with. So each overlap holds such a place strictly inside; a stretch without one makes a longer chunk.
    """
    start = 0
    while True:
        found = _TURN.search(text, start + chunk)
        if not found:
            yield start, len(text), -1
            return
        turn = found.start() + 1
        following = max(start + chunk, turn - overlap)
        end = min(len(text), max(following + overlap, turn + 2))
        yield start, end, following
        start = following


#: A visible character and white space after it, for Python and for the pattern.
_TURN = re.compile(r"[^\s\x1c-\x1f][^\S\x1c-\x1f]")


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(key, no, start, head, follow, piece) of rows (key, text): ``head`` is the end of the chunk before."""
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for rb in batches:
        for key, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
            text, head = text.as_py(), 0
            # few chunks at a time, so that a very long text is not held twice
            for some in batched(enumerate(chunks(text, chunk, overlap)), 64):
                rows = []
                for no, (start, end, follow) in some:
                    rows.append((key, no, start, head, follow, text[start:end]))
                    head = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "no", "start", "head", "follow", "piece"])


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) of chunks (key, no, start, head, head_at, tail, tail_at, ids) sorted by key and no.

    ``head`` and ``tail`` are the boundaries in the overlaps with the chunk before and the one after, as places of the
    text; the two chunks change over at the first place that both have.
    """
    key, parts, tail, tail_at, last = None, [], None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([b"".join([*parts, last])], pa.binary())], names=["key", "ids"])

    for rb in batches:
        for i in range(rb.num_rows):
            k, no, head, head_at, now_tail, now_tail_at, ids = (rb.column(c)[i] for c in range(7))
            ids = ids.as_py()
            if no.as_py() == 0:
                if key is not None:
                    yield done()
                key, parts, begin = k.as_py(), [], 0
            else:
                mine, at = np.array(head.values), np.array(head_at.values)
                both, here, there = np.intersect1d(tail, mine, assume_unique=True, return_indices=True)
                if not len(both):
                    raise AssertionError("neighbouring chunks share no boundary")
                parts.append(last[: 4 * int(tail_at[here[0]])])
                begin = int(at[there[0]])
            last = ids[4 * begin :]
            # places before the change-over are the next chunk's own guess
            tail_at = np.array(now_tail_at.values) - begin
            tail, tail_at = np.array(now_tail.values)[tail_at >= 0], tail_at[tail_at >= 0]
    if key is not None:
        yield done()


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Append ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to each row.

    Texts of up to ``chunk`` characters are encoded where they are, without a shuffle. Longer ones are cut; their
    chunks are dealt to all tasks by the text's digest and their number, which folds copies of a text into one, and
    only ids move from there to be stitched. The rows meet them by digest again. A null text counts as empty. Repeated
    rows give repeated results, an empty table an empty one; input columns with the outputs' names are replaced.
    """
    common.ship(df)
    names = ["n_tokens", "ids"]
    keep = common.without(df, names) if keep is None else keep
    src = df.select(*[df[f"`{c}`"].alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit("")).alias("__text"))
    held = [f"__k{i}" for i in range(len(keep))]
    spelt = spelled(pattern)

    def whole():
        codec = _codec(path, spelt)
        return lambda texts: [codec.encode_bytes(texts)]

    fields = [T.StructField("ids", T.BinaryType())]
    size = F.length("__text")
    short = common.map_text(src.filter(size <= chunk), "__text", fields, whole, held)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ints = _codec(path, spelt), pa.list_(pa.int64())
        for whole in batches:
            for rb in common.text_slices(whole, 5):
                rows = []
                starts, heads, follows, pieces = (rb.column(c).to_pylist() for c in range(2, 6))
                for start, head, follow, (ends, before, ids) in zip(starts, heads, follows, codec.chunks(pieces, [f < 0 for f in follows]), strict=True):
                    ends = ends + start
                    first = slice(0, int(np.searchsorted(ends, head, side="right")) if start else 0)
                    after = slice(int(np.searchsorted(ends, follow)) if follow >= 0 else len(ends), None)
                    rows.append((ends[first], before[first], ends[after], before[after], ids))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *[pa.array(c, ints) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["key", "no", "head", "head_at", "tail", "tail_at", "ids"])
        common.release()

    long = src.filter(size > chunk).withColumn("__key", F.unhex(F.sha2("__text", 256)))
    cut = long.select("__key", "__text").mapInArrow(lambda it: _cut(it, chunk, overlap), "key binary, no int, start long, head long, follow long, piece string")
    once = cut.dropDuplicates(["key", "no"])
    parts = once.mapInArrow(encoded, "key binary, no int, head array<long>, head_at array<long>, tail array<long>, tail_at array<long>, ids binary")
    found = parts.repartition("key").sortWithinPartitions("key", "no").mapInArrow(_stitched, "key binary, ids binary")
    met = long.select(*held, "__key").join(found, F.col("__key") == F.col("key")).select(*held, "ids")
    both = short.select(*held, "ids").unionByName(met)
    return both.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Append ``decoded`` (binary): the raw bytes of the ids, which need not be valid UTF-8 before they are joined.

    Null ids decode to no bytes. An id that the file does not have is an error. One pass without a shuffle.
    """
    common.ship(df)
    keep = common.without(df, ["decoded"])
    src = df.select(*[df[f"`{c}`"] for c in keep])
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        strings = model.strings
        for whole in batches:
            for rb in common.text_slices(whole, at):
                out = [b"".join(map(strings.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in rb.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.binary())], names=[*rb.schema.names, "decoded"])
        common.release()

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    """The columns of the query: ids and decoded bytes as SHA-256."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

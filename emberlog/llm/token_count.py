"""Token counts: whole pre-tokens that are one token are counted at once, only the rest is merged."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .bpe import Cache, Model, byte_alphabet, load, merge, spelled

#: Pattern of byte-level pre-tokens, a fixed value of the file format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[<L>]+| ?[<N>]+| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+"


def proven_whole(model: Model) -> frozenset[str]:
    """Texts of the vocabulary strings that encode alone as their one token.

    A string is proven by running the merges over its own bytes and ending with its one id; strings whose bytes are
    no valid UTF-8 cannot be pre-tokens and are left out.
    """
    code = {c: b for b, c in enumerate(byte_alphabet())}
    whole = []
    for s, i in model.vocab.items():
        raw = bytes(code[c] for c in s)
        if merge(model.symbols(raw), model.pairs) == [i]:
            try:
                whole.append(raw.decode())
            except UnicodeDecodeError:
                continue
    return frozenset(whole)


class Merger:
    """Merges many short pre-tokens at once with numpy, one merge for each of them in a round."""

    NONE = np.int64(1) << 40

    def __init__(self, model: Model):
        pairs = sorted(((a << 20) | b, rank, both) for (a, b), (rank, both) in model.pairs.items())
        self._keys, self._ranks, self._both = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self._first = np.array([-1 if i is None else i for i in model.inner], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 20) | b
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = self._keys[i] == key
        return np.where(hit, self._ranks[i], self.NONE), self._both[i]

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece: in every round the leftmost pair of least rank of each piece is merged."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        sym = self._first[np.frombuffer(b"".join(pieces), np.uint8)]
        who = np.repeat(np.arange(len(pieces)), lens)
        alive = sym >= 0
        sym, who = sym[alive], who[alive]
        rank, both = np.full(len(sym), self.NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], both[:-1] = self._rank(sym[:-1], sym[1:])
            rank[:-1][who[:-1] != who[1:]] = self.NONE
        while len(sym):
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            done = least == self.NONE
            out[who[start[done]]] = size[done]
            at = np.flatnonzero((rank == np.repeat(least, size)) & (rank != self.NONE))
            at = at[np.r_[True, who[at][1:] != who[at][:-1]]] if len(at) else at
            sym[at] = both[at]
            stay = np.repeat(~done, size)
            stay[at + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[at] = True
            # the pair on the left of each merge and the pair that it now begins have new ranks
            moved[at[at > 0] - 1] = True
            sym, who, rank, both, moved = sym[stay], who[stay], rank[stay], both[stay], moved[stay]
            new = np.flatnonzero(moved)
            last = new == len(sym) - 1
            inner = new[~last]
            rank[new[last]] = self.NONE
            rank[inner], both[inner] = self._rank(sym[inner], sym[inner + 1])
            rank[inner[who[inner] != who[inner + 1]]] = self.NONE
        return out.tolist()


class Counter:
    """Counts tokens of texts for a byte-level BPE file.

    A text is first cut into units that the pattern treats independently: visible characters with at most one space
    before them, and white space. Units are remembered in a bounded cache.
    """

    _UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    _SEPARATORS = re.compile(r"[\x1c-\x1f]")  # white space for re, visible for the pattern
    LONG = 64

    def __init__(self, path: str, pattern: str | None = None, whole: frozenset[str] | None = None):
        self.model = load(path)
        self.whole = proven_whole(self.model) if whole is None else whole
        self._pieces = re.compile(pattern or spelled(PIECES))
        self._merge = Merger(self.model)
        self._units, self._merged = Cache(None), Cache(None)

    def _find(self, cache: Cache, keys: set[str], count) -> dict[str, int]:
        """Counts of all ``keys``, from the cache or in one call of ``count``."""
        got = {k: n for k in keys if (n := cache.get(k) or cache.old.get(k)) is not None}
        missing = [k for k in keys if k not in got]
        got.update(zip(missing, count(missing), strict=True))
        for k, n in got.items():
            if k not in cache:
                cache.put(k, n)
        return got

    def _piece_counts(self, pieces: list[str]) -> list[int]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [r for r in raw if len(r) <= self.LONG]
        n = iter(self._merge.counts(short))
        return [next(n) if len(r) <= self.LONG else len(merge(self.model.symbols(r), self.model.pairs)) for r in raw]

    def _unit_counts(self, units: list[str]) -> list[int]:
        cut = [self._pieces.findall(u) for u in units]
        whole = self.whole
        rest = self._find(self._merged, {p for c in cut for p in c if p not in whole}, self._piece_counts)
        return [sum(1 if p in whole else rest[p] for p in c) for c in cut]

    def counts(self, texts: list[str]) -> list[int]:
        special, cut, added = self.model.special, [], []
        for t in texts:
            parts, n = [t], 0
            if special and "<" in t and special.search(t):
                parts = special.split(t)
                n = len(parts) // 2
                parts = parts[::2]
            units = []
            for p in parts:
                units += self._pieces.findall(p) if self._SEPARATORS.search(p) else self._UNITS.findall(p)
            cut.append(units)
            added.append(n)
        got = self._find(self._units, set().union(*cut), self._unit_counts)
        return [n + sum(map(got.__getitem__, u)) for u, n in zip(cut, added, strict=True)]

    def count(self, text: str) -> int:
        return self.counts([text])[0]


@lru_cache(maxsize=2)
def _whole(path: str) -> frozenset[str]:
    return proven_whole(load(path))


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str, whole: frozenset[str]) -> Counter:
    return Counter(path, pattern, whole)


def count_tokens(df: DataFrame, path: str, limit: int = 512, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to each row.

    One pass without a shuffle over whole texts. A null text counts as empty: 0 bytes, 0 tokens, not over the limit.
    A text of any length is counted whole, in one worker. Repeated rows give repeated results, an empty table an empty
    one; input columns with the outputs' names are replaced.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    pattern, whole = spelled(PIECES), _whole(path)

    def make():
        counter = _counter(path, pattern, whole)

        def f(texts: list) -> list:
            n = counter.counts([t or "" for t in texts])
            return [[len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]]

        return f

    return common.map_text(df, text_col, fields, make, keep)

"""BPE encoding and decoding with a heap of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from . import common

#: Most entries of a worker's cache in each of two generations. Results do not depend on it.
CACHE_ENTRIES = 60_000
CACHE_CHARS = 48
#: Text bytes that are encoded and decoded at once: a worker holds texts, ids and decoded texts of so many, twice over.
SLICE_BYTES = 1 << 20


class Cache(dict):
    """A bounded dict that computes what is missing: when the newer generation is full, it becomes the older one."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.compute(key)
        self.put(key, got)
        return got

    def put(self, key: str, value) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value


def merge(symbols: list, pairs: dict) -> list:
    """Apply merges in rank order, leftmost first among equals.

    ``symbols``: the start symbols. ``pairs``: (left, right) -> (rank, merged symbol).
    The heap holds (rank, position, left, right); an entry is stale when the symbols at its position have changed
    since it was pushed. O(n log n) for n symbols.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    heap = []
    get = pairs.get
    for i in range(n - 1):
        m = get((sym[i], sym[i + 1]))
        if m is not None:
            heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
    heapify(heap)
    while heap:
        _, i, a, b, both = heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = both, None
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            m = get((both, sym[k]))
            if m is not None:
                heappush(heap, (m[0], i, both, sym[k], m[1]))
        h = prv[i]
        if h >= 0:
            m = get((sym[h], both))
            if m is not None:
                heappush(heap, (m[0], h, sym[h], both, m[1]))
    return [s for s in sym if s is not None]


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Bodies of character classes: L letters, N numbers, S white space, as ranges of code points.

    Libraries follow different Unicode versions, so the classes are read from the regular expressions of the
    tokenizers library itself: it splits one string of all code points, and its pieces are the ranges.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    got = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        split = pre_tokenizers.Split(Regex(f"[{pattern}]+"), "removed", invert=True)
        got[name] = "".join(f"\\U{ord(w[0]):08x}-\\U{ord(w[-1]):08x}" for w, _ in split.pre_tokenize_str(every))
    return got


def spelled(pattern: str) -> str:
    """Write out a pattern that names the classes as <L>, <N> and <S> inside brackets."""
    for k, v in classes().items():
        pattern = pattern.replace(f"<{k}>", v)
    return pattern


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each of the 256 bytes.

    Printable Latin-1 bytes stand for themselves, the others take the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Model:
    """Vocabulary and merges of a tokenizer file, with symbols as ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            both = self.vocab.get(a + b)
            if both is not None and a in self.vocab and b in self.vocab:
                self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, both))
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in alphabet]

    def symbols(self, piece: bytes) -> list[int]:
        """Start symbols of a pre-token; bytes without a vocabulary string are left out, as the model has no unknown token."""
        got = [self.inner[b] for b in piece[:-1]] + [self.last[b] for b in piece[-1:]]
        return [s for s in got if s is not None]

    def piece(self, piece: str) -> list[int]:
        return merge(self.symbols(piece.encode("utf-8", "surrogatepass")), self.pairs)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


class WordCodec:
    """Encoder and decoder for the lower-casing vocabulary with word ends.

    A text is NFC-normalised, lower-cased character by character and cut into contractions, letter runs, single
    digits and runs of other visible characters. White space is dropped, so that each stretch between white space is
    encoded by itself and remembered in a bounded cache.
    """

    #: Pattern of the vocabulary's pre-tokens, a fixed value of the file format.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[<L>]+|[<N>]|[^<S><L><N>]+"
    #: str.split() also cuts at these, which are no white space for the pattern.
    _SEPARATORS = re.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str, patterns: tuple[str, str] | None = None):
        pieces, space = patterns or self.patterns()
        self.model = load(path)
        self._pieces, self._space = re.compile(pieces), re.compile(space)
        #: Normalisation of text beyond ASCII follows the library's Unicode version too.
        self._fold = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self._words = Cache(lambda w: np.array(self.model.piece(w), "<u4").tobytes())
        self._units = Cache(self._unit)
        self._string = [self.model.strings.get(i, "") for i in range(max(self.model.strings) + 1)]

    @classmethod
    def patterns(cls) -> tuple[str, str]:
        return spelled(cls.PIECES), spelled("[<S>]+")

    def _plain(self, unit: str) -> bytes:
        unit = unit.lower() if unit.isascii() else self._fold(unit)
        return b"".join(map(self._words.__getitem__, self._pieces.findall(unit)))

    def _unit(self, unit: str) -> bytes:
        m = self.model
        if m.special and "<" in unit and m.special.search(unit):
            return b"".join(np.array([m.added[x]], "<u4").tobytes() if x in m.added else self._plain(x) for x in m.special.split(unit))
        return self._plain(unit)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        units = self._space.split(text) if self._SEPARATORS.search(text) else text.split()
        return b"".join(map(self._units.__getitem__, units))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by spaces: the file names no decoder, and then the strings stay as they are."""
        return " ".join(map(self._string.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str, patterns: tuple[str, str]) -> WordCodec:
    # a worker may come from another stage with what that one has kept
    common.forget()
    return WordCodec(path, patterns)


common.CACHES += [_codec.cache_clear, load.cache_clear]


def encode_decode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` to each row.

    One pass without a shuffle. A null text counts as empty: no ids and an empty decoded text. Very long words are
    merged in O(n log n); pairs of equal rank merge from the left. Repeated rows give repeated results, an empty table an
    empty one. Input columns with the outputs' names are replaced.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    patterns = WordCodec.patterns()

    def make():
        codec = _codec(path, patterns)

        def f(texts: list) -> list:
            ids = [codec.encode_bytes(t or "") for t in texts]
            return [[len(x) // 4 for x in ids], ids, [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]]

        return f

    return common.map_text(df, text_col, fields, make, keep, SLICE_BYTES)


def digests(df: DataFrame) -> DataFrame:
    """The columns of the query: ids and decoded texts as SHA-256."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sha256_ids(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

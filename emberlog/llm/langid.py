"""Language identification by compression: the language whose dictionary makes a text smallest wins."""

from __future__ import annotations

import math
import unicodedata

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNDETERMINED = "und"

#: Least margin of the winner, as a share of its size. Of sf0.01, with training rows, 0.5 % of the texts lie below
#: 0.0209; random letters lie below it but for 2 of 21 texts, 120 clean ones of 4 to 20 words above 0.08.
NARROW = 0.02


class Classifier:
    """Compares compressed sizes under per-language raw-content zstandard dictionaries.

    ``samples``: language -> training texts in a fixed order. Each language has ``shards`` dictionaries; each text goes
    whole into the one that is least filled. A text is compressed in blocks of ``block`` bytes, so that it cannot
    become its own dictionary. Block i of n meets the ceil(shards / n) dictionaries from number i on, in turn: a text
    meets all of them, or as many as it has blocks, and the mean over dictionaries is finer than whole bytes.
    """

    #: Shorter texts are repeated up to this length: else zstandard stores them as they are, of one size for all.
    LEAST = 256

    def __init__(self, samples: dict[str, list[str]], shards: int, level: int = 5, block: int = 2048):
        self.langs = sorted(samples)
        self.block, self.shards = block, shards
        self._squeeze = {}
        for lang in self.langs:
            fill: list[list[bytes]] = [[] for _ in range(shards)]
            for t in samples[lang]:
                min(fill, key=lambda parts: sum(map(len, parts))).append(self.fold(t))
            made = []
            for parts in fill:
                # a raw-content dictionary needs 8 bytes at least
                d = zstandard.ZstdCompressionDict(b"\n".join(parts).ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self._squeeze[lang] = made

    @staticmethod
    def fold(text: str) -> bytes:
        return b" " + " ".join(unicodedata.normalize("NFC", text).lower().split()).encode("utf-8", "replace") + b" "

    def sizes(self, text: str) -> dict[str, float]:
        """Compressed bytes of a text under each language: the sum over its blocks of the mean over their dictionaries."""
        raw = self.fold(text)
        if len(raw) < self.LEAST:
            raw *= -(-self.LEAST // len(raw))
        cuts = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        each = -(-self.shards // len(cuts))
        pairs = [(c, (i + j) % self.shards) for i, c in enumerate(cuts) for j in range(each)]
        return {k: sum(len(v[j](c)) for c, j in pairs) / each for k, v in self._squeeze.items()}

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """(language, score, rejected): ``und`` for a text that is null or has no letter.

        ``narrow``: the share of the winner's size that its margin must exceed.
        """
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        best = min(self.langs, key=lambda k: (sizes[k], k))
        score = 1.0 / sum(math.exp(sizes[best] - n) for n in sizes.values())
        margin = min((n - sizes[best] for k, n in sizes.items() if k != best), default=math.inf)
        return best, score, margin <= narrow * sizes[best]


def training_sample(df: DataFrame, docs_each: int, dict_bytes: int, shards: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Whole texts of each language in the order of their hashed ids: a bounded, documented sample.

    Of the texts of up to ``dict_bytes`` UTF-8 bytes, the first in that order, until ``docs_each`` rows or
    ``dict_bytes * shards`` bytes are reached. Languages are counted first; a bound on the hash then picks about twice
    ``docs_each`` rows of each, of which ids and lengths come to the driver, and at last the texts that are chosen.
    """
    fits = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= dict_bytes)
    src = df.filter(fits).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    draw = F.pmod(F.xxhash64("__id"), F.lit(_DRAWS))
    share = {r[0]: min(_DRAWS, -(-2 * docs_each * _DRAWS // r[1])) for r in src.groupBy("__lang").count().collect()}
    if not share:
        return {}
    bound = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("__lang")]
    found = src.filter(draw < bound).select("__id", "__lang", draw.alias("d"), F.octet_length("__text").alias("n")).collect()
    room = dict.fromkeys(share, (docs_each, dict_bytes * shards))
    rank: dict = {}
    for r in sorted((r for r in found if r["__id"] is not None), key=lambda r: (r["d"], r["__id"])):
        rows, size = room[r["__lang"]]
        # the first row that does not fit closes its language
        room[r["__lang"]] = (rows - 1, size - r["n"]) if r["n"] <= size else (0, 0)
        if rows and r["n"] <= size:
            rank.setdefault((r["__lang"], r["__id"]), len(rank))
    ids = sorted({i for _, i in rank})
    samples: dict[str, list[tuple]] = {}
    for i, lang, text in src.filter(F.col("__id").isin(ids)).distinct().collect() if ids else []:
        if (lang, i) in rank:
            samples.setdefault(lang, []).append((rank[lang, i], text))
    return {k: [t for _, t in sorted(v)] for k, v in samples.items()}


#: Values that the draw of a training row can take.
_DRAWS = 1 << 40


def identify(
    df: DataFrame,
    train: DataFrame,
    docs_each: int = 400,
    dict_bytes: int = 96 << 10,
    shards: int = 4,
    narrow: float = NARROW,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``lang_pred``, ``score`` (0 to 1) and ``rejected`` to each row of ``df``.

    The dictionaries are learned from at most ``docs_each`` labelled rows of each language in ``train``, and at most
    ``dict_bytes * shards`` bytes of whole texts of up to ``dict_bytes`` each; predictions use the text alone, whole
    whatever its length, and run in one pass without a shuffle. ``score`` weighs the winner's size against the others'
    with a factor of e for each byte; of equal sizes the language first by name wins. ``rejected``: the winner's margin is
    ``narrow`` of its size or less, or the text is null or has no letter, which gives ``und`` with score 0. Without
    training rows every text is ``und``; an empty table gives an empty one. Repeated rows give repeated results; input
    columns with the outputs' names are replaced.
    """
    samples = training_sample(train, docs_each, dict_bytes, shards, id_col, text_col, lang_col)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def make():
        model = Classifier(samples, shards)
        return lambda texts: list(map(list, zip(*[model.predict(t, narrow) for t in texts], strict=True)))

    return common.map_text(df, text_col, fields, make, keep)


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: CRC-32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))

"""The language classifier against a plain replay: sample, dictionaries, sizes and margins written out anew."""

import math
import unicodedata

import zstandard
from pyspark.sql import functions as F

from emberlog.llm import langid

ROWS, BYTES, SHARDS, BLOCK = 12, 4096, 2, 700


def folded(t):
    return (" " + " ".join(unicodedata.normalize("NFC", t).lower().split()) + " ").encode()


def size(raw, dictionary):
    d = zstandard.ZstdCompressionDict(dictionary.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=5)
    c = zstandard.ZstdCompressor(level=5, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(c.compress(raw))


def test_against_a_plain_replay(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.withColumn("held", langid.held_out()).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.draw, r.doc_id)):
        if not r.held and r.lang is not None and r.text is not None and len(r.text.encode()) <= BYTES:
            by.setdefault(r.lang, []).append(r.text)
    for texts in by.values():
        fits = [sum(len(t.encode()) for t in texts[: i + 1]) <= BYTES * SHARDS and i < ROWS for i in range(len(texts))]
        del texts[fits.index(False) if False in fits else len(texts) :]
    dictionaries = {}
    for lang, texts in by.items():
        parts = [[] for _ in range(SHARDS)]
        for t in texts:
            parts[min(range(SHARDS), key=lambda i: (sum(map(len, parts[i])), i))].append(folded(t))
        dictionaries[lang] = [b"\n".join(p) for p in parts]
    original = langid.Classifier.__init__
    monkeypatch.setattr(langid.Classifier, "__init__", lambda self, samples, shards, level=5, block=BLOCK: original(self, samples, shards, level, BLOCK))
    some = [r for r in rows if len(r.text) < 6000][:60]
    model = langid.Classifier(langid.training_sample(docs.filter(~langid.held_out()), ROWS, BYTES, SHARDS), SHARDS)
    for r in some:
        raw = folded(r.text)
        if len(raw) < 256:
            raw *= -(-256 // len(raw))
        cuts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        each = math.ceil(SHARDS / len(cuts))
        sizes = {k: sum(size(c, v[(i + j) % SHARDS]) for i, c in enumerate(cuts) for j in range(each)) / each for k, v in dictionaries.items()}
        best = min(sizes, key=lambda k: (sizes[k], k))
        margin = min(n - sizes[best] for k, n in sizes.items() if k != best)
        score = 1 / sum(math.exp(sizes[best] - n) for n in sizes.values())
        lang, got, rejected = model.predict(r.text, 0.02)
        assert lang == best and abs(got - score) < 1e-12 and rejected == (margin <= 0.02 * sizes[best])

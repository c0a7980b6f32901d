"""Token counts, BPE codec, media columns, language ID and the pipeline against libraries and plain code."""

import hashlib
import importlib.util
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import bpe, langid, media, queries, substring_dedup, token_count

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, n_tokens string, lang string, feature int"
PIECES = ["a", "B", "'s", "'LL", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "Σ", "ς", "İ", "é", "é", "9", "½", "<|endoftext|>", "<|startoftext|>", "<|", "漢字", "😀", "ﬁ", "　", "\x00", "the", "ing", "\U0003f031", "\U00016111"]


def odd_texts():
    rng = random.Random(3)
    out = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(12)) for _ in range(1500)]
    return [*out, "a" * 5000, "ab" * 4000, " " * 1000, "!" * 3000]


def test_codec_and_counts_equal_the_library():
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    codec, counter = bpe.WordCodec(WORD), token_count.Counter(BYTE)
    texts = odd_texts()
    for t in texts:
        e = word.encode(t, add_special_tokens=False)
        assert codec.encode(t) == e.ids
        assert codec.decode(e.ids) == word.decode(e.ids, skip_special_tokens=False)
    assert counter.counts(texts) == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]
    whole = token_count.proven_whole(counter.model)
    assert len(whole) > 40_000 and all(len(byte.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 500))


def test_merge_skips_stale_entries():
    pairs = {("a", "b"): (0, "ab"), ("b", "c"): (1, "bc"), ("ab", "c"): (2, "abc")}
    assert bpe.merge(list("abcbc"), pairs) == ["abc", "bc"]
    assert bpe.merge(list("aab"), pairs) == ["a", "ab"] and bpe.merge([], pairs) == []


def test_cache_forgets_without_changing_results():
    c = bpe.Cache(len, 3)
    assert [c[x * n] for n in range(1, 9) for x in "ab"] == [n for n in range(1, 9) for _ in "ab"]
    assert len(c) <= 3 and len(c.old) <= 3


def test_queries_on_edge_cases(spark):
    rows = [(1, None, "x", "en", 1), (2, "", "x", "en", 1), (3, "Hello  world's <|endoftext|>", "x", None, 1), (3, "Hello  world's <|endoftext|>", "x", None, 1), (None, "x " * 40_000, "x", "fr", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    counted = token_count.count_tokens(df, BYTE)
    assert sorted(counted.columns) == sorted(["doc_id", "text", "lang", "feature", "n_bytes", "n_tokens", "over_limit"])
    got = sorted((r.doc_id or 9, r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect())
    assert got[0] == (1, 0, 0, False) and got[1] == (2, 0, 0, False) and got[2] == got[3] and got[4][3]
    ids = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(df, WORD)).collect()}
    assert ids[1].n_tokens == 0 and ids[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert ids[3].ids_sha256 == bpe.sha256_ids(Tokenizer.from_file(WORD).encode(rows[2][1], add_special_tokens=False).ids)
    shown = {r.doc_id: r for r in media.digests(media.media_columns(df)).collect()}
    assert shown[1].payload_bytes == 64 and shown[1].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() == shown[2].payload_sha256
    for f in (token_count.count_tokens, bpe.encode_decode):
        assert f(df.limit(0), WORD).count() == 0
    assert media.media_columns(df.limit(0)).count() == 0


def test_media_query(spark, sf):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_media_columns(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        raw = text[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (3, 4, 3)])
def test_images_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    small = media.area_resize(image if image.ndim == 2 else image[:, :, 0], 4, 4)
    assert small.shape == (4, 4)


def test_area_resize_is_the_mean_of_areas():
    image = np.arange(36, dtype=np.uint8).reshape(6, 6)
    want = image.reshape(3, 2, 3, 2).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 3, 3), want)
    assert np.allclose(media.area_resize(image, 6, 6), image)
    fine = np.kron(image, np.ones((4, 4))).reshape(4, 6, 4, 6).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 4, 4), fine)
    assert media.decode(b"P1\n# c\n2 2\n1 0\n0 1").tolist() == [[0, 255], [255, 0]] and media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert np.load(__import__("io").BytesIO(media.npy(image))).tolist() == image.tolist()


def test_broken_images_are_null(spark):
    df = spark.createDataFrame([(1, bytearray(media.encode_netpbm(np.zeros((2, 3), np.uint8)))), (2, bytearray(b"junk")), (3, None)], "id int, m binary")
    got = {r.id: (r.height, r.width) for r in media.image_columns(df, "m").collect()}
    assert got == {1: (2, 3), 2: (None, None), 3: (None, None)}


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op7_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_id_edge_cases(spark):
    rows = [(i, t, None, lang, 1) for i, (t, lang) in enumerate([("the cat sat on the mat " * 5, "en"), ("le chat est sur le tapis " * 5, "fr"), (None, "en"), ("123 !!", "fr"), ("", None), ("the mat", None)])]
    df = spark.createDataFrame([*rows, rows[0], (None, "le tapis", None, None, 1)], SCHEMA)
    got = langid.identify(df, df, narrow=0.0).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].rejected and by[2].score == 0
    assert by[5].lang_pred == "en" and by[None].lang_pred == "fr"
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), df).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mixing", "bpe_codec"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 80")
    one = cp.language(spark, docs, sf)
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    cut = cp.repeated_passages(spark, docs, sf).orderBy("doc_id").collect()
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for r in cut:
        f = found[r.doc_id]
        assert r.text == (f.kept if f.n_removed else f.text) and r.n_chars == len(r.text)
    mixed = cp.source_mix(spark, docs, sf)
    last = cp.tokens(spark, mixed, sf).collect()
    assert len(last) == mixed.count() and mixed.select(F.max("doc_id")).first()[0] < 80

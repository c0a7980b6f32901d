"""Byte-level BPE by ranks against the library, with chunks of a few characters."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from emberlog.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens int, __key string"
PIECES = ["a", "B", "'s", "'LL", "'re", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", "Σ", "İ", "é", "9", "½", "<|endoftext|>", "漢字", "😀", "ﬁ", "\u3000", "\x00", "the", "ing", "\U0003f031", "\U00016111", "--", "supercalifragilistic"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, byte_bpe.spelled(public_tokenizers.PATTERN))


def odd_texts():
    rng = random.Random(3)
    out = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(12)) for _ in range(1500)]
    return [*out, "a" * 5000, "ab" * 4000, " " * 1000, "!" * 3000, "x" * 200 + " " * 90 + "y"]


def test_codec_equals_the_library(codec, library):
    texts = odd_texts()
    for text, ids in zip(texts, codec.encode_bytes(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode() == library.decode_bytes(library.encode_ordinary(text))


def test_forgetting_changes_nothing(library):
    small = byte_bpe.Codec(PATH, byte_bpe.spelled(public_tokenizers.PATTERN))
    small.ENTRIES = 10
    for text in odd_texts()[:300]:
        assert small.encode(text) == library.encode_ordinary(text)


def test_chunks_cover_the_text_and_hold_a_turn():
    rng = random.Random(5)
    for text in ["".join(rng.choices(["a", "b ", " ", "\n", "\x1d", "!"], k=rng.randint(0, 300))) for _ in range(400)]:
        found = list(byte_bpe.chunks(text, 16, 4))
        assert found[0][0] == 0 and found[-1][1:] == (len(text), -1)
        for (_, end, follow), (start, _, _) in zip(found, found[1:], strict=False):
            assert follow == start < end and re.search(r"[^\s][^\S\x1c-\x1f]", text[start:end])


@pytest.mark.parametrize("size", [(9, 3), (16, 4), (40, 12)])
def test_stitched_chunks_equal_the_library(spark, library, size):
    texts = [t for t in odd_texts() if len(t) > size[0]][:900]
    rng = random.Random(size[0])
    texts += [" ".join("".join(rng.choices("ab'\u00e9", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(5)]
    rows = [(i, t, "x", 1, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *rows[:40]], SCHEMA).repartition(5)
    got = byte_bpe.decode(byte_bpe.encode(df, PATH, public_tokenizers.PATTERN, chunk=size[0], overlap=size[1]), PATH).collect()
    assert len(got) == len(texts) + 40
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == texts[r.doc_id].encode() and r["__key"] is None and r.text == texts[r.doc_id]


def test_edge_cases(spark, library):
    rows = [(1, None, "x", 1, "k"), (2, "", None, None, None), (3, "Hello  world's <|endoftext|>", "x", 1, None), (3, "Hello  world's <|endoftext|>", "x", 1, None), (None, "x " * 50_000, "x", 1, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "__key", "n_tokens", "ids"]
    got = sorted((r.doc_id or 9, r.n_tokens, bytes(r.ids)) for r in out.collect())
    own = [np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes() for r in rows]
    assert got == sorted((r[0] or 9, len(x) // 4, x) for r, x in zip(rows, own, strict=True))
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().decoded == b""


def test_query(spark, sf, library):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_byte_bpe_codec(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()

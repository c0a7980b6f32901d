"""Substring dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from emberlog.llm import substring_dedup as sd


def brute(rows, width):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    first, out = {}, []
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            if first.setdefault(tuple(w[s : s + width]), (k, s)) != (k, s):
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def got(df, width=20):
    return sorted((tuple(r) for r in sd.digests(sd.remove_repeats(df, width)).collect()), key=key)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(sd, "SHARD_BYTES", 3000)
    monkeypatch.setattr(sd, "AUTOMATON_WORDS", 60)


def test_whole_table(spark, sf, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(sd, "SHARD_BYTES", 60_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == sorted(brute(rows, 20), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, small_blocks, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "é", "\x85x"]
    common = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(4)]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice([rng.choice(common), " ".join(rng.choices(words, k=rng.randint(0, 5))), "a a a a a"]) for _ in range(rng.randint(0, 4)))
        rows.append((rng.randint(-5, 10**12), t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4) == sorted(brute(rows, 4), key=key)


def test_edge_cases(spark, small_blocks):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None, 1, "k"), (4, "", 2, "k"), (1, "a b c d", 3, "k"), (1, "a b c d", 4, "k"), (2, "x a b c d y", None, "k"), (None, "a b c d", 6, None), (9, long, 7, "k"), (10, "z " + long, 8, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    assert got(df, 4) == sorted(brute([(r[0], r[1]) for r in rows], 4), key=key)
    assert sd.remove_repeats(df, 4).columns == ["doc_id", "text", "n_words", "n_removed", "kept"]
    assert sd.remove_repeats(df.limit(0), 4).count() == 0


def test_packing_and_automata():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (sd.unpack_sorted(sd.pack_sorted(h)) == h).all()
    hits = sd.occurrences(["abc\U00011170ab", "ic\U00011170"], ["ab", "c\U00011170"])
    assert [sorted(x) for x in hits] == [[(0, 0), (2, 1), (4, 0)], [(1, 1)]]


def test_word_spans_over_pieces(monkeypatch):
    text = b"one  two\tthree \x0b\xc2\x85x averyveryverylongwordbeyondapiece end\n"
    whole = sd.word_spans(text)
    monkeypatch.setattr(sd, "PIECE", 7)
    for a, b in zip(whole, sd.word_spans(text), strict=True):
        assert (a == b).all()
    assert [text[a:b] for a, b in zip(*whole[:2], strict=True)] == text.split()


def test_hash_collisions_change_nothing(spark, sf, monkeypatch):
    """With hashes of few bits nearly all windows are candidates; words still decide."""
    monkeypatch.setattr(sd, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(sd, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(sd, "SPARE_BITS", -18)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == sorted(brute(rows, 20), key=key)


def test_more_words_than_characters(monkeypatch):
    rng = random.Random(2)
    some = [" ".join(rng.choices("abcdefgh", k=30)).encode() for _ in range(20)]
    want = sd._late(some, 3)
    assert any(want)
    monkeypatch.setattr(sd, "ALPHABET", 3)
    assert sd._late(some, 3) == want


def test_automata_decide(monkeypatch):
    a, b = b"a b c d e f", b"x c d e f y"
    assert sd._late([a, b], 4) == [[], [1]]
    monkeypatch.setattr(sd, "occurrences", lambda docs, passages: [[] for _ in docs])
    assert sd._late([a, b], 4) == [[], []]

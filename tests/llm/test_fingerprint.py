"""Fingerprints: edits, equal texts, and collision rates against generalised Jaccard similarity."""

import hashlib
import math
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from emberlog.llm import fingerprint

SCHEMA = "doc_id long, text string, n_chars string"


def words(t):
    return Counter(w for w in (t or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if w)


def jaccard(a, b):
    a, b = words(a), words(b)
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edit(t, after):
    cut = len(t) // 3
    return t[: len(t) - cut] + after[:cut]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert sorted(got) == sorted(text)
    off, seen = [], {}
    for i, t in text.items():
        r, edited = got[i], edit(t, text[after[i]])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        off.append(r.near_edited - jaccard(t, edited))
        off.append(r.near_next - jaccard(t, text[after[i]]))
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.3
    assert sum(x * x for x in off) / len(off) < 0.005


def test_edge_cases(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "c", None), (None, "a b", "x"), (None, None, "x"), (5, "", "x"), (9, "q " * 40_000 + "z", "x")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (1, 1), (1, 3), (1, 3), (5, 0), (9, 80_001)]
    same = {r.fingerprint for r in got if r.n_chars == 3}
    assert len(same) == 1
    assert fingerprint.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(4, "abcdef", "x")], SCHEMA)).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_samples_against_plain_python(spark):
    """Every sample's value from Python's own XXH64, logarithms and gamma draws."""
    def uniform(h, part):
        return ((h >> 21 * part & (1 << 21) - 1) + 0.5) * 0.5**21

    def value(term, weight, d):
        base = xxhash.xxh64_intdigest(struct.pack("<q", term), 42)
        one, two = (xxhash.xxh64_intdigest(struct.pack("<i", 2 * d + k), base) for k in (0, 1))
        r, c = -math.log(uniform(one, 0) * uniform(one, 1)), -math.log(uniform(two, 0) * uniform(two, 1))
        b = uniform(one, 2)
        t = math.floor(math.log(weight) / r + b)
        return math.log(c) - r * (t - b + 1)

    texts = ["a b b c c c c", "b b a", "  ", "one two three " * 40, "ünï a"]
    rows = [(i, word, n) for i, t in enumerate(texts) for word, n in Counter(t.split()).items()]
    df = spark.createDataFrame(rows, "id int, w string, n long").withColumn("t", F.xxhash64("w"))
    got = df.groupBy("id").agg(*[F.min(fingerprint.sample(F.col("t"), F.ln("n"), d)).alias(f"s{d}") for d in range(fingerprint.SAMPLES)]).collect()
    terms = {r.w: r.t for r in df.select("w", "t").distinct().collect()}
    assert len(got) == 4
    for r in got:
        for d in range(fingerprint.SAMPLES):
            want = min(value(terms[w], n, d) for w, n in Counter(texts[r.id].split()).items())
            assert abs(r[f"s{d}"] - want) < 1e-9 * max(1.0, abs(want))

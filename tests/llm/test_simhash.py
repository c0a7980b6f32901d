"""SimHash groups against brute force, and the bucket search against all pairs."""

import random

import numpy as np
import pandas as pd
import xxhash

from emberlog.llm import simhash

EDGE = "doc_id long, text string, fp string, extra int"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    comp = {}
    left = set(range(len(ids)))
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = [j for j in left if bin(fps[i] ^ fps[j]).count("1") <= 2]
            left.difference_update(near)
            todo += near
        least = min(ids[i] for i in seen)
        comp.update((ids[i], least) for i in seen)
    return comp


def test_forest_links_what_all_pairs_link():
    rng = random.Random(5)
    for size in (10, 300, 900):
        base = rng.getrandbits(64) & ~0xFFFFFFFF
        fps = np.unique(np.array([base | rng.getrandbits(11) << 3 for _ in range(size)], np.uint64))
        a, b = simhash._forest(fps, 0xFFFFFFFF, 2)
        ids = [int(x) for x in fps]
        want = brute_components(ids, ids)
        got = {x: x for x in ids}

        def root(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            got[root(x)] = root(y)
        assert len({root(x) for x in ids}) == len(set(want.values()))


def test_links_with_crowded_buckets_and_components(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(120):
            x = base
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.choice([*range(12), *range(34, 40)])
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    want = brute_components(fps, fps)
    for crowded in (2, 8, 10_000):
        got = {x: x for x in fps}

        def root(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in simhash.links(df, crowded).collect():
            a, b = a & (2**64 - 1), b & (2**64 - 1)
            assert bin(a ^ b).count("1") <= 33
            got[root(a)] = root(b)
        assert len({root(x) for x in fps}) == len(set(want.values()))


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], fps)
    got = simhash.digests(simhash.near_duplicates(docs)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps, strict=True)}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_edge_cases(spark):
    rows = [(3, None, "x", 1), (1, "", "x", 1), (2, " \t", None, None), (7, "Word", "x", 1), (7, "Word", "x", 1), (8, "word", "x", 1), (None, "other words here", "x", 1)]
    df = spark.createDataFrame(rows, EDGE)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 7
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[7] == comp[8] == 7 and comp[None] is None
    kept = simhash.one_of_each(df)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 7]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000, "", 0), (2, "a b c", "", 0)], EDGE)
    assert {r.fp for r in simhash.with_fingerprint(long, keep=["doc_id"]).collect()} == {np.int64(np.uint64(brute_fp("w w w")).astype(np.int64)), np.int64(np.uint64(brute_fp("a b c")).astype(np.int64))}


def test_no_group_loses_all_its_rows(spark):
    """Null and repeated ids: a document is an id and a text."""
    rows = [(None, "a text of its own", "x", 1), (None, "copied words of one", "x", 2), (1, "copied words of one", "x", 3), (2, "another text here", "x", 4), (2, "quite different words", "x", 5), (2, "another text here", "x", 6), (None, "twice without an id", "x", 7), (None, "twice without an id", "x", 8), (None, None, "x", 9), (5, "", "x", 10)]
    df = spark.createDataFrame(rows, EDGE).repartition(3)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(kept.collect(), key=lambda r: r[3])
    assert [r[3] for r in got if r[3] not in (4, 6, 7, 8)] == [1, 3, 5, 10]
    assert len([r for r in got if r[3] in (4, 6)]) == 1 and len([r for r in got if r[3] in (7, 8)]) == 1 and len(got) == 6
    assert sorted(simhash.one_of_each(df).collect(), key=lambda r: r[3]) == got


def test_random_ids_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(12)]
    rows = [(rng.choice([None, None, *range(5)]), rng.choice(texts), "x", i) for i in range(120)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, EDGE).repartition(4)).collect()
    groups = brute_components(list(range(12)), [brute_fp(t) for t in texts])
    group = {t: groups[i] for i, t in enumerate(texts)}
    assert sorted(group[r[1]] for r in kept) == sorted({group[r[1]] for r in rows})

"""Near-duplicates by shingle sets against brute force over all pairs."""

import random

from emberlog.llm import overlap

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    root = {s: s for s in sets}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    todo = list(sets)
    for k, a in enumerate(todo):
        for b in todo[:k]:
            both = len(a & b)
            if both and 5 * both >= 4 * (len(a) + len(b) - both):
                root[top(a)] = top(b)
    least = {}
    for s, ids in sets.items():
        least[top(s)] = min([*ids, least.get(top(s), ids[0])])
    return {i: least[top(s)] for s, ids in sets.items() for i in ids}


def test_pairs_that_two_bits_of_a_fingerprint_miss(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert want[177] == 1 and want[145] == 6
    assert {r.doc_id: r.component_id for r in overlap.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == set(want.values())


def test_groups_of_edited_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None, ""), (2, " ", "x"), (3, "Few Words", "x"), (4, "few words", "x")]
    for _ in range(6):
        base = rng.choices(words, k=rng.randint(30, 160))
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [rng.choice(words)]
            rows.append((len(rows) + 1, " ".join(w), "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:2] for r in rows])
    assert 10 < len(set(want.values())) < 200
    assert {r.doc_id: r.component_id for r in overlap.near_duplicates(df).collect()} == want
    assert overlap.near_duplicates(df.limit(0)).count() == 0

"""Targets, flow and selection of the mix."""

import itertools
import re

from emberlog.llm import mixing


def test_targets_stop_and_reshare():
    got = mixing.targets({"b": 1000, "a": 10, None: 100, "c": 5})
    # order a, b, c, null with weights 5, 2, 1, 5
    assert got["a"] == 30 and got["c"] == 15 and got[None] == 300
    assert abs(sum(got.values()) - 1115) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_route_repeats_last_and_is_minimal():
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 2}
    got = mixing.route(patterns, {"a": 18, "b": 14})
    used = {p: sum(v.values()) for p, v in got.items()}
    assert sum(used.values()) == 32
    cost = sum(max(0, used[p] - n) + max(0, used[p] - 2 * n) for p, n in patterns.items())
    best = min(
        max(0, x - 10) + max(0, x - 20) + max(0, y - 10) + max(0, y - 20) + max(0, z - 2) + max(0, z - 4)
        for x, y, z in itertools.product(range(31), range(31), range(7))
        if x + y + z == 32 and x <= 18 and z <= 14 and 18 - x <= y and 14 - z <= y
    )
    assert cost == best


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in rows.items()}
    by = {}
    for i, n in sizes.items():
        by[rows[i].source] = by.get(rows[i].source, 0) + n
    goal = mixing.targets(by)
    taken = dict.fromkeys(by, 0)
    for r in got:
        s = rows[r.doc_id].source
        assert r.size == sizes[r.doc_id] and r.source_size == by[s] and abs(r.target - goal[s]) < 1e-9
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
    for s, t in taken.items():
        longest = max(n for i, n in sizes.items() if rows[i].source == s)
        assert abs(t - goal[s]) <= longest / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, size int, target string"
    df = spark.createDataFrame([(1, None, None, 1, "x"), (2, "", "a", 1, "x"), (3, "a b\x0bc", "a", 1, None), (3, "a b\x0bc", "a", 1, "x"), (None, "w " * 50_000, "b", 1, "x")], schema)
    got = mixing.mix(df).collect()
    assert len(got) == 5 and {r.source_size for r in got} == {0, 6, 50_000}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.take(df).columns == df.columns
    over = spark.createDataFrame([(1, "a b", ["x", "y", None]), (2, "a b c d", ["x"]), (3, "q", []), (4, "r s t", ["y", "y"])], "doc_id long, text string, source array<string>")
    assert {r.doc_id for r in mixing.mix(over).collect()} == {1, 2, 3, 4}


def test_overlapping_sources(spark):
    """Each source of an overlap comes near its target, by the flow worked out for patterns; most documents once before any twice."""
    import random

    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice([["a"], ["a", "b"], ["b", "c"], ["c"], ["a", "b", "c"], [], None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    sizes, patterns = {}, {}
    for _, t, s in rows:
        p = tuple(sorted(s)) if s else (None,)
        patterns[p] = patterns.get(p, 0) + t.count("w")
        for x in p:
            sizes[x] = sizes.get(x, 0) + t.count("w")
    goal = mixing.targets(sizes)
    flows = mixing.route(patterns, goal)
    for x, g in goal.items():
        assert abs(sum(f.get(x, 0) for f in flows.values()) - g) <= 1 or sum(patterns[p] * 3 for p in patterns if x in p) < g
    taken = {}
    for i, t, s in rows:
        p = tuple(sorted(s)) if s else (None,)
        r = got[i]
        assert r.size == t.count("w") and 0 <= r.taken <= 3 * r.size and r.source_size == sum(sizes[x] for x in p)
        taken[p] = taken.get(p, 0) + r.taken
    for p, n in taken.items():
        assert abs(n - sum(flows[p].values())) <= 16


def test_rows_without_an_id_are_told_apart_by_text(spark):
    df = spark.createDataFrame([(None, "w " * (1 + i % 7) + str(i), "a") for i in range(300)] + [(1, "x " * 3000, "b")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    a = [r for r in got if r.source_size != 3000]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 8 and len({r.taken // r.size for r in a}) > 1


def test_many_rows_without_an_id_are_taken_one_by_one(spark):
    rows = [(None, "w " * (10 + i % 7), "big", i) for i in range(400)] + [(5, "same words here", "big", i) for i in range(50)] + [(i, "x " * 20, "small", i) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int").repartition(3)
    mixed = mixing.mix(df)
    want = {r["source_size"]: r["n"] for r in mixed.groupBy("source_size").sum("taken").withColumnRenamed("sum(taken)", "n").collect()}
    taken = mixing.take(df)
    assert taken.columns == df.columns
    got = {}
    for r in taken.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    sizes = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in ("big", "small")}
    assert got == {s: want[n] for s, n in sizes.items()}
    goal = mixing.targets(sizes)
    assert all(abs(got[s] - goal[s]) <= 20 for s in sizes)


def test_over_a_hundred_thousand_sources(spark):
    df = spark.range(200_000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 9 AS INT)) AS text", "concat('s', id) AS source")
    got = mixing.mix(df).selectExpr("count(*) AS n", "sum(taken) AS taken", "sum(size) AS size", "sum(target) AS target", "max(taken - 3 * size) AS over").first()
    assert got.n == 200_000 and got.over <= 0
    assert abs(got.target - got.size) < 1e-3 * got.size and abs(got.taken - got.size) < 0.2 * got.size

"""Components of edge tables: stars within tasks and rounds of shuffles, against a search on the driver."""

import random

import pytest

from emberlog.llm import components


def brute(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(parent)}


def graph():
    rng = random.Random(5)
    chain = list(range(-150, 150))
    rng.shuffle(chain)
    edges = [(chain[i], chain[i + 1]) for i in range(len(chain) - 1)]
    edges += [(5000, 5000 + i) for i in range(1, 200)] + [(9000, 8000 + i) for i in range(200)]
    edges += [(rng.randrange(10_000, 10_600), rng.randrange(10_000, 10_600)) for _ in range(300)]
    edges += [(1 << 62, -(1 << 62)), (7, None), (None, 8), (77_777, 77_777)] + edges[:50]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("together", [1 << 18, 40])
def test_components_match_a_search_whether_or_not_one_task_holds_all_edges(spark, monkeypatch, together):
    monkeypatch.setattr(components, "TOGETHER", together)
    edges = graph()
    got = [tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_no_edges_no_components(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_take_few_tasks_however_many_shuffle_partitions_there_are(spark):
    edges = spark.createDataFrame(graph(), "a long, b long").repartition(3)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("components", "few edges")
    try:
        components.components(edges)
    finally:
        sc._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("components") for s in seen.getJobInfo(j).stageIds}
    assert 0 < sum(info.numTasks for s in stages if (info := seen.getStageInfo(s))) < 50

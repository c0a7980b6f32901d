"""The prefix trie against plain Python and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from emberlog.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, rep int"


def brute(rows):
    """All nodes by sets of prefixes; rows: (conv_id, turn, role, text, ...)."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids[p])
    ends = {p: sorted(c for c in m if len(built[c]) == len(p)) for p, m in nodes.items()}
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in nodes.items()
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(70), 45):
        n = rng.choice([1, 1, 2, 3, 5, 9])
        script = [rng.choice(["a b", "c", "", None, "d  e\tf"]) for _ in range(n)] if rng.random() < 0.6 else ["a b", "c", "a b", "c", "x y z"][:n]
        for i, text in enumerate(script):
            rows.append((c, rng.choice([i, i, None]) if rng.random() < 0.1 else i, rng.choice(["user", None]) if i % 2 else "user", text, "x", 1))
    rows += rng.choices(rows, k=5)
    rng.shuffle(rows)
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(empty)) == []
    # ids whose first turns are all replaced by those of a conversation that is not there
    gone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:6]
    rows = [(c, 0, "user", "hello there", None, None) for c in gone]
    got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) == [(gone[0], 0, None, 6, 0, 1, 0, hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest())]
    rows = [(None, 0, "user", "x", None, None), (20, None, None, None, None, None), (20, 1, "a", "b " * 20_000, None, None)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_deep_shared_prefixes(spark):
    base = [(20 * k, i, "user", f"w{i} w", None, None) for k in range(1, 31) for i in range(12)]
    longer = [(20 * k, 12, "user", f"end {k % 3}", None, None) for k in range(1, 20)]
    rows = base + longer
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force_and_sql(spark, size):
    sf = f"/root/testdata/{size}"
    got = rows_of(queries.op12_prefix_trie(spark, sf))
    want = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    assert got == brute(want)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    told = db.sql(queries.oracle_sql()["op12_prefix_trie"])
    assert sorted(told.columns) == sorted(COLUMNS)
    assert sorted(told.select(*[duckdb.ColumnExpression(c) for c in COLUMNS]).fetchall(), key=lambda r: (r[0], r[1])) == got

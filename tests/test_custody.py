"""Custody by file bytes: one changed byte or swapped rows are found and the chunk is named."""

import hashlib
import random

import pytest

from emberlog.sources import custody


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    at = tmp_path / "files"
    (at / "below").mkdir(parents=True)
    (at / "a.log").write_bytes(b"".join(b"%d,%d\n" % (i, rng.randrange(10**6)) for i in range(600)))
    (at / "below" / "b.bin").write_bytes(bytes(rng.randrange(256) for _ in range(5000)))
    (at / "empty.txt").write_bytes(b"")
    (at / "no_end.txt").write_bytes(b"one\ntwo")
    return at


def test_unchanged_files_hold_and_changes_are_named(spark, folder, tmp_path):
    sealed = custody.seal(spark, str(folder), str(tmp_path / "leaves"), chunk=1000)
    assert custody.holds(spark, str(folder), sealed) and custody.changes(spark, str(folder), sealed).count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert custody.holds(spark, str(folder), sealed)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = folder / "a.log"
    was = a.read_bytes()
    changed = bytearray(was)
    changed[4321] ^= 1
    a.write_bytes(changed)
    assert not custody.holds(spark, str(folder), sealed)
    got = custody.changes(spark, str(folder), sealed).collect()
    assert [(r["name"], r["start"]) for r in got] in ([("a.log", 4000)], [("a.log", 3000)])
    lines = was.split(b"\n")
    lines[5], lines[500] = lines[500], lines[5]
    a.write_bytes(b"\n".join(lines))
    assert not custody.holds(spark, str(folder), sealed)
    assert {r["name"] for r in custody.changes(spark, str(folder), sealed).collect()} == {"a.log"}
    a.write_bytes(was)
    assert custody.holds(spark, str(folder), sealed)
    b = folder / "below" / "b.bin"
    raw = bytearray(b.read_bytes())
    raw[17] ^= 255
    b.write_bytes(raw)
    assert [r["name"] for r in custody.changes(spark, str(folder), sealed).collect()] == ["below/b.bin"]


def test_lengths_names_and_losses(spark, folder, tmp_path):
    sealed = custody.seal(spark, str(folder), str(tmp_path / "leaves"), chunk=1000)
    n = folder / "no_end.txt"
    n.write_bytes(b"one\ntwo\n")
    assert [(r["name"], r["start"]) for r in custody.changes(spark, str(folder), sealed).collect()] == [("no_end.txt", -1)]
    n.write_bytes(b"one\ntwo")
    n.rename(folder / "other.txt")
    assert not custody.holds(spark, str(folder), sealed)
    (folder / "other.txt").rename(n)
    moved = tmp_path / "elsewhere"
    moved.mkdir()
    folder.rename(moved / "files")
    assert custody.holds(spark, str(moved / "files"), sealed)
    assert custody.holds(spark, str(folder), sealed) is False


def test_root_is_the_tree_of_its_leaves(spark):
    leaves = [("x", -1, b"n" * 32), *[("x", 10 * i, bytes([i]) * 32) for i in range(7)]]
    got = custody.root(spark.createDataFrame(leaves, "name string, start long, hash binary"), chunk=10, fan=3)
    level = {0 if s < 0 else s // 10 + 1: h for _, s, h in leaves}
    while max(level):
        up = {}
        for at in sorted(level):
            up.setdefault(at // 3, []).append(f"{at}:{level[at].hex().upper()}")
        level = {k: hashlib.sha256(",".join(v).encode()).digest() for k, v in up.items()}
    name = hashlib.sha256(b"x/").hexdigest()
    assert got == hashlib.sha256(f"{name}:{level[0].hex().upper()}".encode()).hexdigest()
    many = [(f"f{i}", -1, bytes([i % 256]) * 32) for i in range(500)]
    whole = spark.createDataFrame(many, "name string, start long, hash binary")
    assert custody.root(whole.repartition(7), fan=16) == custody.root(whole, fan=16) != custody.root(whole.limit(499), fan=16)

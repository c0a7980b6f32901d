"""Replacement in text columns against a plain longest match; concurrent writers of a shared dictionary."""

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from emberlog.operators import privacy, replacement
from emberlog.sources.shared import SharedDictionary


def plain(text, words, stop):
    """From the left, at each place the longest word that stands there as a whole; (text, number of replacements)."""
    out, at, n = [], 0, 0
    while at < len(text):
        best = None
        if at == 0 or not re.match("[A-Za-z0-9_]", text[at - 1]):
            for w in words:
                end = at + len(w)
                if text.startswith(w, at) and not re.match(stop, text[end : end + 1] or " ") and (best is None or len(w) > len(best)):
                    best = w
        if best:
            out.append(words[best])
            at, n = at + len(best), n + 1
        else:
            out.append(text[at])
            at += 1
    return "".join(out), n


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_a_plain_longest_match(spark, seed):
    rng = random.Random(seed)
    bit = ["ana", "perez", ".", " ", "-", "10", "/", "\\", "é", "_x", "Bob", "\n", "漢"]
    value = lambda: "".join(rng.choices(bit, k=rng.randint(1, 4))).strip() or "anna"
    values = sorted({value() for _ in range(60)})
    tables = {c: spark.createDataFrame([(v, f"{c.upper()}-{i:04d}") for i, v in enumerate(values[k::2])], "value string, alias string") for k, c in enumerate(("user", "host"))}
    texts = ["".join(rng.choices([*bit, *values], k=rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, *texts[:10], None])], "id int, text string, hits string").repartition(3)
    got = replacement.aliased(df, "text", tables).collect()
    assert len(got) == 161 and got[0].asDict().keys() == {"id", "text", "replaced", "hits", "doubts"}
    real = {r["value"]: r["alias"] for t in tables.values() for r in t.collect()}
    sure = {v: a for v, a in real.items() if len(v) >= 4 and not v.isdigit()}
    for r in got:
        if r.text is None:
            assert r.replaced is None and not r.hits and not r.doubts
            continue
        want, n = plain(r.text, sure, "[A-Za-z0-9_]")
        assert r.replaced == want and sum(h.n for h in r.hits) == n
    back = replacement.revealed(df.withColumn("text", F.regexp_replace("text", "ana", "USER-0001")), "text", tables).collect()
    names = {a: v for v, a in real.items()}
    assert all(r.replaced == plain(r.text, names, "[0-9]")[0] for r in back if r.text is not None)


def test_empty_tables_and_texts(spark):
    table = {"user": spark.createDataFrame([], "value string, alias string")}
    df = spark.createDataFrame([("",), ("ana.perez",), (None,)], "text string")
    assert [r.replaced for r in replacement.aliased(df, "text", table).orderBy("text").collect()] == [None, "", "ana.perez"]
    assert replacement.aliased(df.limit(0), "text", table).count() == 0


def test_real_hits_leaves_out_program_names(spark):
    rows = [("powershell.exe", "PROC-0001"), ("C:\\\\tools\\\\evil.exe", "PROC-0002"), ("secret-host", "PROC-0003")]
    d = privacy.Dictionary({"process_name": spark.createDataFrame(rows, "value string, alias string")})
    text = "ran powershell.exe on secret-host and C:\\\\tools\\\\evil.exe"
    assert d.find_real(text) == {("process_name", f"PROC-000{i}") for i in (1, 2, 3)}
    assert d.real_hits(text) == {("process_name", "PROC-0002"), ("process_name", "PROC-0003")}


def test_concurrent_writers_agree(spark, tmp_path):
    rng = random.Random(1)
    parts = [[(f"u{rng.randrange(40)}", i) for i in range(60)] for _ in range(4)]
    failed = []

    def work(rows):
        try:
            shared = SharedDictionary(spark, str(tmp_path / "dict"))
            df = spark.createDataFrame(rows, "user_id string, source_row int")
            shared.extend("user_id", df, "user_id", "source_row")
            shared.base("source_row", df.withColumn("source_row", F.col("source_row") + len(failed) + rows[0][1] + 5))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(p,)) for p in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed, failed
    shared = SharedDictionary(spark, str(tmp_path / "dict"))
    rows = shared.table("user_id").collect()
    values = {v for p in parts for v, _ in p}
    assert {r.value for r in rows} == values and len(rows) == len(values) == len({r.alias for r in rows})
    assert {r.alias for r in rows} == {f"U-{i:04d}" for i in range(1, len(values) + 1)} or len({r.alias.split("-")[1] for r in rows}) == len(values)
    number, manifest = shared.latest()
    assert number >= 2 and manifest["shifts"]["source_row"] == 5
    again = shared.extend("user_id", spark.createDataFrame(parts[0], "user_id string, source_row int"), "user_id", "source_row")
    assert shared.latest()[0] == number and again.count() == len(values)
    assert shared.base("source_row", spark.createDataFrame([(1,)], "source_row int")) == 5

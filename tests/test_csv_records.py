"""CSV records over several lines: the same rows as one task reads, from chunks of a few bytes."""

import random

import pytest

from emberlog.sources import csv_records, readers


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def whole(spark, path, sep=",", header=True):
    return spark.read.option("multiLine", True).option("escape", '"').option("header", header).option("sep", sep).csv(path)


def cell(rng, sep):
    kind = rng.random()
    word = "".join(rng.choices(["a", "é", "1", " ", "x\\y", "'"], k=rng.randint(0, 6)))
    if kind < 0.4:
        return word
    if kind < 0.5:
        return word + 'in"ch'  # a mark in a plain field opens nothing
    inner = "".join(rng.choices(["b", "\n", "\n\n", '""', sep, " ", "\r\n", "long text "], k=rng.randint(0, 9)))
    return f'"{inner}"'


@pytest.mark.parametrize(("seed", "sep", "end", "sent"), [(1, ",", "\n", 1 << 20), (2, ";", "\r\n", 1 << 20), (3, "\t", "\n", 0), (4, ",", "\n", 1 << 20), (5, "|", "\n", 0)])
def test_random_quoting_equals_one_task(spark, small_splits, tmp_path, seed, sep, end, sent):
    rng = random.Random(seed)
    rows = [sep.join(["id", "a", "b", "c"])]
    for i in range(300):
        rows.append(sep.join([f"r{i}", *[cell(rng, sep) for _ in range(3)]]))
        if rng.random() < 0.05:
            rows.append("")
    path = tmp_path / "x.csv"
    path.write_bytes(end.join(rows).encode() + (end.encode() if seed % 2 else b""))
    want = whole(spark, str(path), sep).collect()
    assert len(want) == 300
    lines = csv_records.lines_of(spark, str(path))
    assert lines.rdd.getNumPartitions() > 20 and lines.select("start").distinct().count() > 20
    got = csv_records.read(spark, str(path), sep, sent=sent).orderBy("__number")
    assert got.columns[:-2] == whole(spark, str(path), sep).columns
    rows = got.collect()
    # line ends inside quotes stay as they are; the one-task reader writes those of the file's kind as \\n
    plain = lambda r: tuple(x and x.replace("\r\n", "\n") for x in r) if end == "\r\n" else tuple(r)
    assert [plain(tuple(r)[:-2]) for r in rows] == [plain(r) for r in want]
    assert [r["__number"] for r in rows] == list(range(1, 301))


def test_records_longer_than_chunks_and_several_files(spark, small_splits, tmp_path):
    for n in range(3):
        text = "k,v\n" + "".join(f'{n}{i},"{"line\n" * (i * 11)}end"\n' for i in range(12)) + f'{n}z,"open till the end\n'
        (tmp_path / f"{n}.csv").write_text(text)
    got = csv_records.read(spark, str(tmp_path), ",").collect()
    assert len(got) == 3 * 13
    by = {r["k"]: r for r in got}
    assert all(by[f"{n}{i}"]["v"] == "line\n" * (i * 11) + "end" and by[f"{n}{i}"]["__number"] == i + 1 for n in range(3) for i in range(12))


def test_states_compose_like_one_pass():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices(['"', ",", "a", "\n"], k=rng.randint(0, 24)))
        state, lines = False, text.split("\n")
        for line in lines:
            quoted, at, field = state, 0, not state
            plain = False
            while at < len(line):
                c = line[at]
                if quoted:
                    if c == '"':
                        if line[at + 1 : at + 2] == '"':
                            at += 1
                        else:
                            quoted, plain = False, True
                elif c == ",":
                    field, plain = True, False
                    at += 1
                    continue
                elif c == '"' and field and not plain:
                    quoted = True
                field = False
                at += 1
            assert csv_records.after(line, state) == quoted, (line, state)
            state = quoted


def test_open_source_reads_latin_and_quoted_breaks(spark, small_splits, tmp_path):
    path = tmp_path / "y.csv"
    path.write_bytes("año;nota\n".encode("latin-1") + b"".join(f'{i};"ñ\nlínea {i}"\n'.encode("latin-1") for i in range(60)))
    df, spec = readers.open_source(spark, str(path))
    assert spec.encoding == "ISO-8859-1" and df.columns == ["año", "nota"]
    rows = readers.with_source_row(df).collect()
    assert [(r.source_row, r.nota) for r in rows] == [(i + 1, f"ñ\nlínea {i}") for i in range(60)]


def test_source_row_by_a_join(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").repartition(7)
    ranked = readers.with_source_row(e)
    joined = readers.with_source_row(e, sent=0)
    assert sorted((r.source_row, r.event_id) for r in joined.collect()) == sorted((r.source_row, r.event_id) for r in ranked.collect())
    assert [r.source_row for r in ranked.collect()] == list(range(1, e.count() + 1))


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    assert csv_records.read(spark, str(tmp_path / "e.csv")).count() == 0

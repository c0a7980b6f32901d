"""License scans: planted notices, a brute-force cosine, and inheritance by directories."""

import math
import re

from pyspark.sql import functions as F

from emberlog.llm import license_scan as ls

SCHEMA = "doc_id long, path string, text string, license int"
MIT, GPL = ls.TEMPLATES["MIT"], ls.TEMPLATES["GPL-3.0"]


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(rows):
    df = {}
    for _, _, t in rows:
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1

    def vec(ws):
        return {w: ws.count(w) * math.log(1 + len(rows) / max(1, df.get(w, 0))) for w in ws}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    tv = {k: vec(words(v)) for k, v in ls.TEMPLATES.items()}
    out = {}
    for i, _, t in rows:
        best = None
        for n, line in enumerate((t or "").split("\n")):
            v = vec(words(line))
            for k, u in tv.items():
                if v:
                    c = round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), 9)
                    if c >= ls.THRESHOLD and (best is None or (-c, k, n) < best):
                        best = (-c, k, n)
        out[i] = best
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    rows = [tuple(r) for r in docs.select("doc_id", "path", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in ls.scan(docs).collect()}
    assert sorted(got) == sorted(want)
    for i, b in want.items():
        assert (got[i].license, got[i].line) == ((b[1], b[2]) if b else (None, None))
    assert sum(b is not None for b in want.values()) >= sum(any(t in r[2] for t in ls.TEMPLATES.values()) for r in rows)


def test_inheritance_and_edge_cases(spark):
    rows = [
        (1, "a/LICENSE", MIT, 1),
        (2, "a/b/c/x.txt", "plain words here", 1),
        (3, "a/b/y.txt", "code of its own\n" + GPL + "\n" + "more " * 50, 1),
        (4, "z/x.txt", None, 1),
        (5, "COPYING", GPL, 1),
        (6, "a/b/d/COPYING", GPL, None),
        (7, "a/b/d/e/f.txt", "", 1),
        (8, None, "words", 1),
        (2, "a/b/c/x.txt", "plain words here", 1),
        (None, "top.txt", "other text " * 20_000, 1),
    ]
    got = ls.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10
    by = {r.path: r for r in got}
    assert by["a/LICENSE"].license == "MIT" and by["a/b/y.txt"].license == "GPL-3.0" and by["a/b/y.txt"].line == 1
    assert by["a/b/c/x.txt"].inherited == "MIT" and by["a/b/c/x.txt"].inherited_from == "a/LICENSE"
    assert by["a/b/d/e/f.txt"].inherited == "GPL-3.0" and by["a/b/d/e/f.txt"].inherited_from == "a/b/d/COPYING"
    assert by["z/x.txt"].inherited == by["top.txt"].inherited == "GPL-3.0" and by[None].inherited is None
    assert ls.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_change_nothing(spark):
    """One row of a file, or three of it, make the same directory a licensed one or not."""
    text = "Released under the MIT License.\n" + "other words of a file\n" * 2
    rows = [(1, "d/a.txt", text), (2, "d/b.txt", "plain words")]
    once = {r.doc_id: tuple(r) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    thrice = ls.scan(spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, path string, text string")).collect()
    assert len(thrice) == 4
    assert {r.doc_id: (r.license, r.inherited) for r in thrice} == {i: (r[2], r[5]) for i, r in once.items()}
    apart = ls.scan(spark.createDataFrame([(1, "p/a", "Released under the MIT License."), (1, "p/a", "nothing here")], "doc_id long, path string, text string")).collect()
    assert sorted((r.license or "") for r in apart) == ["", "MIT"]

"""Phrase collocations against plain Python and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from emberlog.llm import phrases, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id long, text string, lang string, rank string, score int"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, longest=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        told = []
        for p, a in some.items():
            if 100 * held[p] >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(told)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def corpus(rng, docs, words):
    rows = []
    for i in range(docs):
        lang = rng.choice(["en", "en", "fr", None])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0c"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text if rng.random() > 0.05 else None, lang, "x", 1))
    return rows


@pytest.mark.parametrize(("seed", "longest", "options"), [(0, 3, {}), (1, 3, {"block_bytes": 500, "bucket": 50, "hot": 30}), (2, 4, {"block_bytes": 300, "bucket": 100, "hot": 200}), (3, 2, {"bucket": 7, "hot": 1})])
def test_random_texts_equal_brute_force(spark, seed, longest, options):
    rng = random.Random(seed)
    words = [rng.choice(["a", "B", "é", "Éa", "the", "İ", "x\x1cy", "漢", "\xa0"]) + rng.choice("abz") * rng.randint(0, 1) for _ in range(14)]
    rows = corpus(rng, 150, words)
    rows += [(1000 + i, "One two two three. one TWO two Three four", "en", None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = rows_of(phrases.collocations(df, longest=longest, top=200, **options))
    assert got == brute([(r[1], r[2]) for r in rows], longest, top=200) and len(got) > 10


def test_each_n_gram_has_one_owner():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ids = rng.integers(0, 6, rng.integers(1, 60)).astype("<u4")
        cols = phrases.fragments(ids, 3)
        got = Counter()
        for gram, weight in phrases.mined(cols, np.ones(cols.shape[1], np.int64), 1):
            got.update(dict(zip(map(tuple, gram.T.tolist()), weight.tolist(), strict=True)))
        want = Counter(tuple(ids[i : i + k].tolist()) for k in (2, 3) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
        assert got == want
        assert all((f[2] >= f).all() for f in cols.T)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "_row_hash", lambda cols: cols[0].astype(np.uint64) % np.uint64(2))
    cols = np.array([[3, 1, 3, 2, 1, 3], [1, 1, 1, 2, 5, 2]], "<u4")
    found, counts, h = phrases.folded(cols, np.ones(6, np.int64))
    assert dict(zip(map(tuple, found.T.tolist()), counts.tolist(), strict=True)) == {(3, 1): 2, (1, 1): 1, (2, 2): 1, (1, 5): 1, (3, 2): 1}
    assert (np.diff(h.astype(np.int64)) >= 0).all()


def test_edge_cases(spark):
    assert rows_of(phrases.collocations(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, None, None, None, None), (2, "", "en", None, None), (3, "...", "en", None, None), (4, "word", "fr", None, None)]
    assert rows_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == []
    rows = [(i, "same Text again", None, None, None) for i in range(10)] + [(11, "z " * 30_000, "fr", None, None)]
    assert rows_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == brute([(r[1], r[2]) for r in rows])


def test_large_counts_are_exact(spark):
    """Scores whose products pass 64 bits."""
    a, l, r = 3_000_000_007, 3_000_000_019, 3_000_000_037
    got = spark.range(1).selectExpr(f"{phrases.SCORE.format(a=f'{a}L', l=f'{l}L', r=f'{r}L')} AS s").first().s
    assert got == 1000000 * a * a // (l * r)


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(queries.op11_phrase_collocations(spark, sf))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == brute(db.sql("SELECT text, lang FROM documents").fetchall())
    told = db.sql(queries.oracle_sql()["op11_phrase_collocations"])
    assert sorted(told.select(*[duckdb.ColumnExpression(c) for c in COLUMNS]).fetchall()) == got

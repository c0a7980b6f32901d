"""The Kneser-Ney model against a plain implementation, and the classifier's edge cases."""

import math
from collections import Counter, defaultdict

from emberlog.llm import kneser_ney as kn


def brute(texts, order):
    """log p(last | rest) of the same model, from dictionaries."""
    top = Counter()
    for t in texts:
        s = kn.PAD * (order - 1) + kn.fold(t)
        top.update(s[i : i + order] for i in range(len(s) - order + 1))
    adj = {order: top}
    for k in range(order - 1, 0, -1):
        adj[k] = Counter(g[1:] for g in adj[k + 1])
    ctx, d = {}, {}
    for k, a in adj.items():
        d[k] = kn.discounts([sum(v == i for v in a.values()) for i in (1, 2, 3, 4)])
        ctx[k] = defaultdict(list)
        for g, v in a.items():
            ctx[k][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / (len(adj[1]) + 1)
        k, seen = len(g), ctx[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda v: d[k][min(v, 3) - 1]
        a = adj[k].get(g, 0)
        return ((a - cut(a)) if a else 0.0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return p


def perplexity(p, text, order):
    s = kn.PAD * (order - 1) + kn.fold(text)
    lp = [math.log(p(s[i : i + order])) for i in range(len(s) - order + 1)]
    return math.exp(-sum(lp) / len(lp)) if lp else None


def test_against_plain_model(spark, sf, monkeypatch):
    monkeypatch.setattr(kn, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(kn, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(kn, "SLICE_BYTES", 9_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.filter("n_chars < 3000").collect()]
    trusted = [t for i, t in rows if i % 3 == 0]
    for order in (2, 5):
        model, unseen = kn.train(docs.filter("doc_id % 3 = 0 AND n_chars < 3000"), order)
        p = brute(trusted, order)
        got = {r.doc_id: r.perplexity for r in kn.perplexities(docs.filter("n_chars < 3000"), model, unseen, order).select("doc_id", "perplexity").collect()}
        assert len(got) == len(rows)
        for i, t in rows[:60]:
            assert abs(got[i] / perplexity(p, t, order) - 1) < 1e-5


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, perplexity int, keep string"
    good = [(i, f"the cat sat on the mat number {i} and the dog sat on the log", "en", 1, "x") for i in range(60)]
    rows = good + [(100, None, "en", 1, "x"), (101, " \n", None, 1, "x"), (102, "the cat and the dog", None, 1, "x"), (None, "the dog", "en", 1, "x"), (5, good[5][1], "en", 1, "x"), (103, "\x02qqq zzz xxq", "en", 1, "x"), (104, "the cat " * 20_000, "de", 1, "x")]
    df = spark.createDataFrame(rows, schema)
    ids = df.filter("doc_id < 60").select("doc_id")
    got = kn.classify(df, ids).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].perplexity is None and not by[100].keep and by[101].n_scored == 0
    assert by[103].perplexity > 3 * by[5].perplexity and not by[103].keep and by[5].keep
    assert by[102].threshold is not None
    assert all(r.keep for r in kn.classify(df.filter("doc_id < 60"), ids.limit(0)).collect())
    assert kn.classify(df.limit(0), ids).count() == 0


def test_classify_against_brute_force_and_labels(spark, sf):
    """Thresholds and decisions by language from plain dictionaries; good text is told from bad text it has not seen."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    ids = {r.doc_id for r in good.collect()}
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 5) AS f").collect()}
    rows = docs.collect()
    p = brute([r.text for r in rows if r.doc_id in ids and fold[r.doc_id]], kn.ORDER)
    want = {r.doc_id: perplexity(p, r.text, kn.ORDER) for r in rows}
    by = defaultdict(list)
    for r in rows:
        if r.doc_id in ids and not fold[r.doc_id] and want[r.doc_id] is not None:
            by[r.lang].append(want[r.doc_id])
    everything = sorted(x for v in by.values() for x in v)
    cut = lambda v: sorted(v)[max(0, math.ceil(0.9 * len(v)) - 1)]
    got = kn.classify(docs, good, quantile=0.9).collect()
    assert len(got) == len(rows)
    for r in got:
        limit = cut(by[r.lang]) if by.get(r.lang) else cut(everything)
        assert abs(r.threshold / limit - 1) < 1e-5 and abs(r.perplexity / want[r.doc_id] - 1) < 1e-5
        assert r.keep == (want[r.doc_id] <= limit * (1 + 1e-6))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    clean = [want[i] for i, q in quality.items() if i in want and q == 1 and i in ids and not fold[i]]
    poor = [want[i] for i, q in quality.items() if i in want and q == 0]
    above = sum((a < b) + (a == b) / 2 for a in clean for b in poor) / (len(clean) * len(poor))
    assert above > 0.8

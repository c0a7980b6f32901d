"""run() of the pipeline against the same stages in plain Python."""

import hashlib
import importlib.util
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import langid, mixing

from .test_overlap import brute as brute_sets


def brute_keep(rows, width=20):
    """{id: text} with the words of repeated windows removed; texts without any stay as they are."""
    first, out = set(), {}
    for i, t in sorted(rows.items()):
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in first:
                gone.update(range(s, s + width))
            first.add(key)
        out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t
    return out


def brute_mix(spark, rows, source):
    sizes = {i: len(t.encode().split()) for i, t in rows.items()}
    by = Counter()
    for i, n in sizes.items():
        by[source[i]] += n
    goal = mixing.targets(by)
    ids = spark.createDataFrame([(i,) for i in rows], "i long").select("i", F.xxhash64(F.lit(42), "i").alias("h")).collect()
    draw = {r.i: r.h % 2**64 for r in ids}
    times = {}
    for s, n in by.items():
        want = round(goal[s])
        base = min(3, want // n) if n else 0
        rest = want - base * n if base < 3 else 0
        upto = 0
        for i in sorted((i for i in rows if source[i] == s), key=lambda i: draw[i]):
            upto += sizes[i]
            extra = rest > 0 and (upto <= rest or (upto - sizes[i] <= rest and 2 * upto - sizes[i] <= 2 * rest))
            times[i] = base + bool(extra)
    return {i: k for i, k in times.items() if k and sizes[i]}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_run_against_plain_python(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 90 OR doc_id % 3 = 0")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}

    model = langid.Classifier(langid.training_sample(docs.filter(~langid.held_out()), 400, 96 << 10, 4), 4)
    text = {i: r.text for i, r in rows.items() if not model.predict(r.text, langid.NARROW)[2]}
    groups = brute_sets(list(text.items()))
    text = brute_keep({i: t for i, t in text.items() if groups[i] == i})
    times = brute_mix(spark, text, {i: r.source for i, r in rows.items()})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, k in times.items():
        ids = library.encode(text[i], add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += k
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeats, an empty table and columns that clash with what the operators give."""
    import corpus_pipeline as cp

    base = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40")
    clash = {"score": "s", "rejected": "r", "lang_pred": "p", "kept": "k", "n_words": "w", "n_removed": "m"}
    for name, value in clash.items():
        base = base.withColumn(name, F.concat(F.lit(value), F.col("doc_id").cast("string")))
    odd = spark.createDataFrame([(100, None, None, None, None, "s100"), (101, "", "en", "web", 0, "s101"), (None, "a text without an id but with words", "en", None, 35, "sx")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs = base.unionByName(base.filter("doc_id = 3")).unionByName(odd, allowMissingColumns=True)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        if name == "bpe_codec":
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.score == f"s{r.doc_id}" for r in rows if r.doc_id is not None and r.doc_id < 40), name
        assert all(r.kept == f"k{r.doc_id}" for r in rows if r.doc_id is not None and r.doc_id < 40), name
        ids = [r.doc_id for r in rows]
        if name == "language_id":
            assert 100 not in ids and 101 not in ids and ids.count(3) == 2
        if name == "simhash_near_dedup":
            assert ids.count(3) == 1 and ids.count(100) == 1 and 101 not in ids
        if name == "substring_dedup":
            assert ids.count(3) == 2 and sum(r.text is None for r in rows) == 1
        if name == "source_mixing":
            assert 100 not in ids and 101 not in ids

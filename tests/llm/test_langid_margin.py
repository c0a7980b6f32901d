"""Narrow margins: gibberish and mixed text are rejected by default, clean short text stays."""

import random

from pyspark.sql import functions as F

from emberlog.llm import langid


def test_default_margin_rejects_gibberish_and_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.filter(~langid.held_out())
    rng = random.Random(5)
    held = docs.filter(langid.held_out() & F.col("lang").isin("fr", "es") & (F.col("n_chars") > 1500)).orderBy("doc_id").collect()
    fr, es = ([r.text.split() for r in held if r.lang == k] for k in ("fr", "es"))
    rows = [(i, "gibberish", " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n))) for i, n in enumerate([10, 20, 40, 80, 200, 400] * 5)]
    rows += [(100 + i, "mixed", " ".join(f"{a} {b}" for a, b in zip(x[:120], y[:120], strict=False))) for i, (x, y) in enumerate(zip(fr, es, strict=False))]
    rows += [(500 + i, "short", " ".join(x[:12])) for i, x in enumerate([*fr, *es])]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, kind string, text string"), train)
    share = {r.kind: r.share for r in got.groupBy("kind").agg(F.avg(F.col("rejected").cast("double")).alias("share")).collect()}
    assert share["gibberish"] >= 0.8 and share["mixed"] >= 0.3 and share["short"] <= 0.02
    whole = langid.identify(docs, train).agg(F.count_if("rejected").alias("n"), F.count_if(F.col("rejected") & (F.col("n_chars") > 0)).alias("junk")).first()
    assert 3 <= whole.n <= 10

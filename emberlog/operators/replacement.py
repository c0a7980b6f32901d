"""Dictionary replacement in text columns: joins of first tokens and lengths, then of the words found, longest match wins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store

#: A run of word characters, or one other character: together they make up a text.
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]")
WORD = "[A-Za-z0-9_]"
#: Values shorter than this, or of digits alone, may be plain words or numbers of a text.
SHORT = 4


def long_form(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(column, value, alias) of all tables of a dictionary."""
    parts = [t.select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), F.col("alias").cast("string").alias("alias")) for c, t in tables.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None


def doubtful(value: Column) -> Column:
    return (F.length(value) < SHORT) | value.rlike("^[0-9]+$")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, token) of each place where a word may begin: not right after a word character."""
    for rb in batches:
        for key, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            starts, tokens, after_word = [], [], False
            for m in TOKEN.finditer(text):
                token = m[0]
                if not after_word:
                    starts.append(m.start())
                    tokens.append(token)
                after_word = token[-1].isascii() and (token[-1].isalnum() or token[-1] == "_")
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(starts), pa.string()), pa.array(starts, pa.int32()), pa.array(tokens, pa.string())], names=["key", "start", "token"])


def places(texts: DataFrame, words: DataFrame, stop: str = WORD) -> DataFrame:
    """(key, start, len, word) of every word of ``words`` in the texts (key, text), as a whole: no ``stop`` character follows.

    A word can begin where a token does that is its first one. So places meet the different (first token, length) of
    the words by an equality join, which gives what stands there, and that meets the words themselves by another. No
    table of words is held in one place.
    """
    store.ship(texts.sparkSession)
    first = F.regexp_extract("word", rf"(?s)^(?:{WORD}+|.)", 0)
    heads = words.filter(F.length("word") > 0).select(first.alias("token"), F.length("word").alias("len")).distinct()
    near = texts.mapInArrow(_starts, "key string, start int, token string").join(heads, "token").groupBy("key").agg(F.collect_list(F.struct("start", "len")).alias("near"))
    seen = texts.join(near, "key").select("key", "text", F.explode("near").alias("n")).select("key", F.col("n.start").alias("start"), F.col("n.len").alias("len"), F.expr("substring(text, n.start + 1, n.len)").alias("word"), F.expr("substring(text, n.start + n.len + 1, 1)").alias("next"))
    return seen.filter((F.length("word") == F.col("len")) & ~F.col("next").rlike(stop)).drop("next").join(words.select("word").distinct(), "word", "left_semi")


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, replaced, taken) of rows (key, text, [(start, len, by)]): from the left, at one place the longest."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32())]))
    for rb in batches:
        out, taken = [], []
        for text, found in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
            at, parts, used = 0, [], []
            for f in sorted(found, key=lambda f: (f["start"], -f["len"])):
                if f["start"] >= at:
                    parts += [text[at : f["start"]], f["by"]]
                    at = f["start"] + f["len"]
                    used.append({"start": f["start"], "len": f["len"]})
            out.append("".join([*parts, text[at:]]))
            taken.append(used)
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.string()), pa.array(taken, kind)], names=["key", "replaced", "taken"])


def replaced(df: DataFrame, text_col: str, rules: DataFrame, stop: str = WORD) -> DataFrame:
    """``df`` with ``replaced`` and ``hits`` (column, word, by, n): words of ``rules`` (column, word, by) replaced in a text.

    Different texts are worked on once, named by their digest, and rows meet them by it. A word that several columns
    hold counts for the first of them by name. A null text stays null and has no hits.
    """
    key = F.sha2(F.col(text_col).cast("string"), 256)
    texts = df.filter(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["key"])
    one = rules.groupBy("word").agg(F.min(F.struct("column", "by")).alias("r")).select("word", "r.column", "r.by")
    found = places(texts, rules, stop).join(one, "word")
    each = found.groupBy("key").agg(F.collect_list(F.struct("start", "len", "by")).alias("found"))
    made = texts.join(each, "key").select("key", "text", "found").mapInArrow(_resolved, "key string, replaced string, taken array<struct<start int, len int>>")
    used = made.select("key", F.explode("taken").alias("u")).select("key", "u.start", "u.len").join(found, ["key", "start", "len"])
    counts = used.groupBy("key", "column", "word", "by").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("column", "word", "by", "n"))).alias("hits"))
    told = made.select("key", "replaced").join(counts, "key").withColumnRenamed("key", "__key")
    keep = [c for c in df.columns if c not in ("replaced", "hits")]
    met = df.withColumn("__own", key).join(told, F.col("__own") == F.col("__key"), "left")
    return met.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(told["replaced"], F.col(text_col).cast("string")).alias("replaced"), F.coalesce(told["hits"], F.array().cast("array<struct<column:string,word:string,by:string,n:bigint>>")).alias("hits"))


def aliased(df: DataFrame, text_col: str, tables: dict[str, DataFrame], literal: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``replaced``, ``hits`` and ``doubts``: real values as aliases; doubtful values, which stay, with theirs.

    Values named in ``literal`` are plain words of the text.
    """
    words = long_form(tables).select("column", F.col("value").alias("word"), F.col("alias").alias("by")).filter(~F.col("word").isin(*literal) if literal else F.lit(True))
    sure = replaced(df, text_col, words.filter(~doubtful(F.col("word"))))
    key = F.sha2(F.col(text_col).cast("string"), 256)
    texts = df.filter(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["key"])
    vague = words.filter(doubtful(F.col("word")))
    seen = places(texts, vague).join(vague.groupBy("word").agg(F.min(F.struct("column", "by")).alias("r")), "word").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("word", F.col("r.by").alias("by")))).alias("doubts"))
    met = sure.withColumn("__own", key).join(seen.withColumnRenamed("key", "__key"), F.col("__own") == F.col("__key"), "left")
    return met.select(*sure.columns, F.coalesce("doubts", F.array().cast("array<struct<word:string,by:string>>")).alias("doubts"))


def revealed(df: DataFrame, text_col: str, tables: dict[str, DataFrame]) -> DataFrame:
    """``df`` with ``replaced`` and ``hits``: aliases as real values; an alias inside a longer name or number stays."""
    words = long_form(tables).select("column", F.col("alias").alias("word"), F.col("value").alias("by"))
    return replaced(df, text_col, words, "[0-9]")

"""A corpus pipeline over `documents`: language, near-duplicates, repeated passages, source mix, BPE ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, common, langid, mixing, overlap, simhash, substring_dedup


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """``docs`` with columns that clash with an operator's outputs renamed, and the columns that name them as before."""
    taken = {n.lower() for n in names}
    own = {c: f"__own_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), [F.col(f"`{n}`").alias(c) for c, n in own.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier finds; those that it rejects go.

    Null and letterless texts go; short and very long ones are judged whole. Repeated rows are judged alike. Without
    labelled rows to learn from, or with none at all, nothing stays. Columns keep their values whatever their names.
    """
    src, same = _aside(docs, ["lang_pred", "score", "rejected"])
    found = langid.identify(src, src.filter(~langid.held_out()))
    return found.filter(~F.col("rejected")).select(*same)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8, the smallest id's.

    Null and wordless texts are one group. A document is an id and a text: rows without an id come after those with
    one, of rows that repeat both one stays, and no group loses all its rows. An empty table gives an empty one.
    Columns keep their values whatever their names.
    """
    return simhash.one_of_each(docs, partial(overlap.near_duplicates, shingle=5, share=0.8))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier; where nothing repeats, the text stays as it is.

    A null text stays null; a text whose words all go is empty. ``n_chars`` follows the text. Repeated rows count as
    documents of their own. An empty table gives an empty one. Columns keep their values whatever their names.
    """
    src, same = _aside(docs, ["n_words", "n_removed", "kept"])
    found = substring_dedup.remove_repeats(src)
    found = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*same)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null, empty and wordless texts are not taken.

    Each row is decided by itself, whether or not its id is null or repeated. An empty table gives an empty one.
    Columns keep their values whatever their names.
    """
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids and their decoding, as digests, for each row that the mix took: a null text counts as empty."""
    return bpe.digests(bpe.encode_decode(docs, common.tokenizer_path("word_bpe_49k.json"), keep=["doc_id"]))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("bpe_codec", tokens),
]

#: SQL can express neither compression, nor hashing by XXH64, nor merges; a test follows the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage that has been read goes."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs

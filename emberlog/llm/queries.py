"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, common, fingerprint, kneser_ney, langid, license_scan, media, mixing, phrases, prefix_trie, simhash, sql, substring_dedup, token_count


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as files: a document's path is its source, language and id."""
    docs = common.table(spark, sf_dir, "documents")
    return license_scan.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, common.tokenizer_path("byte_bpe_50k.json"), limit=512, keep=["doc_id"])


def op3_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return media.digests(media.media_columns(docs, keep=["doc_id", "text"]))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return substring_dedup.digests(substring_dedup.remove_repeats(docs, keep=["doc_id"]))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(common.table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.filter(~langid.held_out()), keep=["doc_id"])
    return found.withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, common.tokenizer_path("word_bpe_49k.json"), keep=["doc_id"]))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted text: documents whose label says good quality and not toxic."""
    labels = common.table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0")
    return kneser_ney.classify(common.table(spark, sf_dir, "documents"), labels.select("doc_id"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(common.table(spark, sf_dir, "conversations"))


def op13_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return byte_bpe.digests(byte_bpe.decode(ids, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_count, op3_document_fingerprint, op4_media_columns, op5_substring_dedup, op6_simhash_near_dedup, op7_language_id, op8_bpe_codec, op9_quality_classifier, op10_source_mixing, op11_phrase_collocations, op12_prefix_trie, op13_byte_bpe_codec)}


def oracle_sql() -> dict[str, str]:
    return sql.SQL

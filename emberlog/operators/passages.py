"""Passages of pages: splitting, search, preparation for a model and IOC files."""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import documents

SHORT, LONG = 200, 1100


def passages_of(text: Column, short: int = SHORT, most: int = LONG) -> Column:
    """Array of a page's passages, as one expression.

    White space is folded within the blocks between blank lines. A block joins the passage before it while that is
    shorter than ``short``. What is longer than ``most`` is cut after the last space that leaves more than half of
    ``most``, else at ``most``; the pattern takes the rest as soon as it fits.
    """
    none = F.array().cast("array<string>")
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))

    def add(done: Column, block: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, block)))
        return F.when(F.length(last) < short, joined).otherwise(F.concat(done, F.array(block)))

    merged = F.aggregate(F.filter(blocks, lambda b: b != ""), none, add)
    half = most // 2
    pieces = rf" ?(.{{1,{most}}}$|.{{{half + 1},{most - 1}}} |.{{{most}}})"
    cut = F.flatten(F.transform(merged, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(pieces), F.lit(1)))))
    return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")


def split(pages: DataFrame, id_col: str, page_col: str, text_col: str, short: int = SHORT, most: int = LONG) -> DataFrame:
    """(id, page, idx, passage): passages of each page without its document's repeated lines, numbered within the page."""
    clean = documents.strip_repeated(pages, id_col, page_col, text_col)
    return clean.select(F.col(id_col).alias("id"), F.col(page_col).alias("page"), F.posexplode(passages_of(F.col(text_col), short, most)).alias("idx", "passage"))


def search(pages: DataFrame, id_col: str, page_col: str, text_col: str, queries: DataFrame, q_id: str, q_text: str, k: int = 5) -> DataFrame:
    """(q, id, page, idx, score, rk): the best passages of all pages for each query."""
    return documents.bm25(split(pages, id_col, page_col, text_col), ["id", "page", "idx"], "passage", queries, q_id, q_text, k)


def prepare_for_model(hits: list[tuple[int, str]], most: int = 6000) -> dict:
    """What would be handed to a model: (page, passage) pairs marked with their page, as many as fit, with pages, size and hash."""
    blocks = [f"[p.{page}] {text}" for page, text in hits]
    fit = sum(1 for size in accumulate(map(len, blocks)) if size <= most)
    text = "\n\n".join(blocks[:fit])
    return {"text": text, "pages": sorted({page for page, _ in hits[:fit]}), "chars": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest()}


def summary(found: DataFrame, n: int = 10) -> DataFrame:
    """Unique values, public ones and mentions of each kind with its most frequent values."""
    w = Window.partitionBy("kind").orderBy(F.col("mentions").desc(), "value")
    top = found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n).groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))), lambda x: x["value"]).alias("top"))
    per = found.groupBy("kind").agg(F.count(F.lit(1)).alias("unique"), F.sum("mentions").alias("mentions"), F.count_if(F.coalesce(F.col("tag") != "not_public", F.lit(True))).alias("public"))
    return per.join(top, "kind")


def per_page(found: DataFrame) -> DataFrame:
    """(id, page, indicators) of ``documents.by_document``'s rows."""
    return found.select("id", F.explode("pages").alias("page")).groupBy("id", "page").agg(F.count(F.lit(1)).alias("indicators"))


def candidates(found: DataFrame) -> DataFrame:
    """Indicators with a tag, which a blocklist leaves out, for a second look."""
    return found.filter("tag IS NOT NULL").select("kind", "value", "tag").orderBy(documents.kind_order(F.col("kind")), "value")


def write_iocs(df: DataFrame, id_col: str, text_col: str, out: str) -> None:
    """Blocklist, tagged candidates and doubtful values as CSV folders; Spark's committer publishes each at once."""
    found = documents.indicators(df, id_col, text_col)
    parts = {"blocklist": documents.blocklist(found), "candidates": candidates(found), "doubtful": documents.doubtful_hex(df, id_col, text_col)}
    for name, part in parts.items():
        part.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")


def analyse(pages: DataFrame, id_col: str, page_col: str, text_col: str, out: str) -> dict[str, str]:
    """Indicators of documents with their pages, key sentences and language hints as tables in one folder."""
    whole = pages.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_col, text_col))), lambda x: x[text_col]), "\n").alias("__text"))
    parts = {
        "indicators": documents.by_document(pages, id_col, page_col, text_col),
        "key_sentences": documents.key_sentences(pages, id_col, page_col, text_col),
        "language": documents.language_hint(whole, id_col, "__text"),
        "passages": split(pages, id_col, page_col, text_col),
    }
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: f"{out}/{name}" for name in parts}

"""Document types by text density, and the strategy that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SAMPLED_PAGES = 5
# Notes of the strategies.
SCANNED_NOTE = "Scanned PDF - requires manual review or OCR"
NO_TEXT_NOTE = "No text content extracted from PDF"
NO_CONTENT_NOTE = "Mixed PDF processing failed - no content"


def document_type(chars: Column, ratio: Column) -> Column:
    """At most 100 meaningful characters: scanned; over 0.3 of 500 a page: text_based; else mixed."""
    return F.when(chars <= 100, "scanned").when((ratio > 0.3) | (chars > 1000), "text_based").otherwise("mixed")


def document_types(pages: DataFrame, doc_id: str = "doc_id", page_no: str = "page_no", text: str = "text", first: int = SAMPLED_PAGES, dropped: str = T.MEANINGLESS) -> DataFrame:
    """(doc_id, total_pages, meaningful_chars, text_ratio, doc_type).  Characters are counted
    where the pages are read and no text is shuffled.  Each task passes on at most ``first`` pages of a
    document, and one count of its pages, so a document of very many pages is no hot key."""
    chars = T.meaningful_chars(F.col(text), dropped).cast("long").alias("_chars")
    order = Window.partitionBy(doc_id).orderBy(page_no, "_chars")
    sampled = pages.select(doc_id, page_no, chars).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= first)
    none = F.lit(0).cast("long")
    counts = sampled.select(doc_id, "_chars", none.alias("_pages")).unionAll(pages.select(doc_id, none.alias("_chars"), F.lit(1).cast("long").alias("_pages")))
    out = counts.groupBy(doc_id).agg(F.coalesce(F.sum("_chars"), F.lit(0)).alias("meaningful_chars"), F.sum("_pages").alias("total_pages"))
    out = out.withColumn("text_ratio", T.text_ratio(F.col("meaningful_chars"), F.least("total_pages", F.lit(first))))
    return out.select(F.col(doc_id).alias("doc_id"), "total_pages", "meaningful_chars", "text_ratio", document_type(F.col("meaningful_chars"), F.col("text_ratio")).alias("doc_type"))


def strategy(doc_type: Column, n_combined: Column, has_text: Column) -> Column:
    """Confidence of the chosen strategy: text documents high, else medium with the line cascade;
    mixed ones medium at most; scanned ones low, for manual review."""
    return (
        F.when(doc_type == "scanned", "low")
        .when((n_combined > 0) & (doc_type == "text_based"), "high")
        .when((n_combined > 0) | has_text, "medium")
        .otherwise("low")
    )


def note(doc_type: Column, n_combined: Column, n_lines: Column, has_text: Column) -> Column:
    """What the chosen strategy did."""
    text, mixed = doc_type == "text_based", doc_type == "mixed"
    said = lambda head, n, tail="": F.concat(F.lit(head), n.cast("string"), F.lit(tail))
    return (
        F.when(doc_type == "scanned", SCANNED_NOTE)
        .when(text & (n_combined > 0), said("Text-based PDF processed with ", n_combined, " financial fields"))
        .when(text & has_text, said("Text-based PDF processed with smart extraction: ", n_lines, " fields"))
        .when(text, NO_TEXT_NOTE)
        .when(mixed & (n_combined > 0), said("Mixed PDF processed with PDF extractor: ", n_combined, " fields"))
        .when(mixed & has_text, said("Mixed PDF processed with smart extraction: ", n_lines, " fields"))
        .otherwise(NO_CONTENT_NOTE)
    )


def recognised_text(words: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, page_no, text) of recognised words (doc_id, page_no, position, word, confidence) that are sure enough."""
    kept = words.filter(F.col("confidence") >= least).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("position", "word"))).alias("w"))
    return kept.select("doc_id", "page_no", F.array_join("w.word", " ").alias("text"))


def joined_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): a document's non-blank pages in order, each under its heading."""
    full = pages.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    headed = F.concat(F.lit("=== 第"), F.col("page_no").cast("string"), F.lit("頁 ===\n"), F.col("text"))
    listed = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", headed.alias("t")))).alias("p"))
    return listed.select("doc_id", F.array_join("p.t", "\n").alias("text"))

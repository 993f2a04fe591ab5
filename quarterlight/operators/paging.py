"""Documents in pages: places in the whole document, without putting it together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Pages of a block in the two-level prefix sums.
BLOCK = 1024


def filled(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of the pages with more than white space.  A document's page numbers differ."""
    return pages.select("doc_id", "page_no", "text").filter((T.strip(F.col("text")) != "") & F.col("page_no").isNotNull())


def heading(page_no) -> F.Column:
    # Fixed value: the line above each page of a joined text.
    return F.concat(F.lit("=== 第"), page_no.cast("string"), F.lit("頁 ===\n"))


def first_lines(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(doc_id, page_no, first_line): the number that a page's first line has in the joined text, of
    documents whose joined text has so many characters.

    Sums run in two levels, over the pages of a block and over a document's blocks, so no
    task sorts more than BLOCK rows of a document, or one row for each of its blocks."""
    lines = F.regexp_count("text", F.lit("\n")) + 1
    narrow = pages.select("doc_id", "page_no", F.floor(F.col("page_no") / BLOCK).alias("block"), (lines + 1).cast("long").alias("lines"), (F.length(heading(F.col("page_no"))) + F.length("text") + 1).cast("long").alias("chars"))
    blocks = narrow.groupBy("doc_id", "block").agg(F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))
    whole = Window.partitionBy("doc_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The joined text has one line end less than it has pages.
    blocks = blocks.select("doc_id", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"), F.sum("chars").over(whole).alias("chars")).filter(F.col("chars") - 1 >= at_least)
    inside = Window.partitionBy("doc_id", "block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    ranked = narrow.select("doc_id", "page_no", "block", F.coalesce(F.sum("lines").over(inside), F.lit(0)).alias("inside"))
    return ranked.join(blocks.select("doc_id", "block", "before"), ["doc_id", "block"]).select("doc_id", "page_no", (F.col("before") + F.col("inside") + 1).alias("first_line"))

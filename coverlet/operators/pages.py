"""Page ranges and texts. Pages are rows (doc_key, page_no from 0, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(*by: str, order: str, text: str = "text", glue: str = "\n"):
    """An aggregate: the group's texts in order, one string."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r.t), glue)


def pages_between(pages: DataFrame, start: int, end: int) -> DataFrame:
    """The pages from start to end, both included, as far as there are such."""
    return pages.where(F.col("page_no").between(max(0, start), end))


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_key, text): each document's pages joined by line feeds; a null text is empty."""
    return pages.groupBy("doc_key").agg(joined(order="page_no").alias("text"))


def range_text(ranges: DataFrame, pages: DataFrame, key: str, start: str = "page_start", end: str = "page_end", most: int | None = None) -> DataFrame:
    """Each range (doc_key, key, start, end) with the text of its pages, `most` of them at most; no pages: empty text.

    The range is exploded to page numbers, so the join is on (doc_key, page_no) and each page moves once.
    """
    last: Column = F.least(F.col(end), F.col(start) + (most - 1)) if most else F.col(end)
    numbered = ranges.withColumn("page_no", F.explode_outer(F.when(last >= F.col(start), F.sequence(F.col(start), last))))
    texts = numbered.select("doc_key", key, "page_no").join(pages, ["doc_key", "page_no"]).groupBy("doc_key", key).agg(joined(order="page_no").alias("text"))
    return ranges.join(texts, ["doc_key", key], "left").withColumn("text", F.coalesce("text", F.lit("")))

"""Pages that arrive as a stream.

Only steps that look at one page at a time fit a stream; contents, chapters and rankings need whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, fix_ligatures
from ..operators.toc import page_score


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_key, page_no, text), streamed or not, with repaired text and how much each looks like contents."""
    text = fix_ligatures(F.coalesce("text", F.lit("")))
    return pages.select("doc_key", "page_no", clean_text(text).alias("text"), page_score(text).alias("toc_score"))

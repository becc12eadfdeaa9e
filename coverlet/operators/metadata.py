"""What is known of a book from its information entries, its file name and its first pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import file_authors, file_title, lit_array, strip
from .pages import full_text

#: Fixed value: pages that are looked at.
FRONT_PAGES = 5


def extract_metadata(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_key, path, title, authors, edition, publisher, year, isbn, book_type) of docs (doc_key, path, info_title, info_author).

    What is missing is the empty string. Only the first pages are read. A generic or very short title gives way to the
    file name's; the edition is the first one named, the year the latest.
    """
    front = full_text(pages.where(F.col("page_no") < FRONT_PAGES)).withColumnRenamed("text", "front")
    rows = docs.join(front, "doc_key", "left").withColumn("front", F.coalesce("front", F.lit("")))
    given, author = strip(F.coalesce("info_title", F.lit(""))), strip(F.coalesce("info_author", F.lit("")))
    real = ~F.array_contains(lit_array(P.GENERIC_TITLES), F.lower(given)) & (F.length(given) > 3)
    named = file_title(F.col("path"))
    title = F.when(real, given).when(named != "", named).otherwise(F.element_at(F.split("path", "/"), -1))
    years = F.transform(F.regexp_extract_all("front", F.lit(P.JAVA_YEAR), F.lit(1)), lambda y: y.cast("int"))
    year = F.array_max(F.filter(years, lambda y: y.between(1900, 2100)))
    return rows.select(
        "doc_key", "path", title.alias("title"), F.when(author != "", author).otherwise(file_authors(F.col("path"))).alias("authors"),
        F.regexp_extract("front", P.JAVA_EDITION, 0).alias("edition"), F.lit("").alias("publisher"), F.coalesce(year.cast("string"), F.lit("")).alias("year"), F.lit("").alias("isbn"), F.lit("Reference").alias("book_type"),
    )

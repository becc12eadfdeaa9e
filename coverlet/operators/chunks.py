"""Chunks of books and the word windows they are matched by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import clean_text, strip, title_prefix, words
from .pages import range_text


def flatten_chapters(chapters: DataFrame) -> DataFrame:
    """One row a section, or a chapter without sections: chunk ids, labels, titles and page ranges, numbered chunk_seq."""
    rows = chapters.select(F.col("doc_key").alias("book_key"), "chapter_no", F.col("label").alias("chapter_label"), F.col("title").alias("chapter_title"), "page_start", "page_end", "book_page_start", "book_page_end", F.explode_outer("sections").alias("s"))
    own = lambda c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c)
    name = F.when(F.col("s").isNull(), F.lit("_")).when(F.col("s.label") != "", F.col("s.label")).otherwise(F.col("s.title"))
    seq = F.row_number().over(Window.partitionBy("book_key").orderBy("chapter_no", F.col("s.seq").asc_nulls_first())) - 1
    return rows.select(
        "book_key", seq.alias("chunk_seq"), F.concat_ws("::", "book_key", "chapter_label", name).alias("chunk_id"), "chapter_label", "chapter_title",
        F.coalesce("s.label", F.lit("")).alias("section_label"), F.coalesce("s.title", F.lit("")).alias("section_title"), *(own(c) for c in ("page_start", "page_end", "book_page_start", "book_page_end")),
    )


def chunk_texts(flat: DataFrame, pages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The chunks with the cleaned text of their pages, a bounded number of them; page_end stays as it is."""
    ranged = range_text(flat.withColumnRenamed("book_key", "doc_key"), pages, "chunk_seq", most=config.chunk_pages)
    return ranged.withColumn("text", clean_text(F.col("text"))).withColumnRenamed("doc_key", "book_key")


def last_of_id(chunks: DataFrame) -> DataFrame:
    """Of chunks with one id the last in order: how colliding ids resolve where ids alone count."""
    back = Window.partitionBy("book_key", "chunk_id").orderBy(F.desc("chunk_seq"))
    return chunks.withColumn("_k", F.row_number().over(back)).where("_k = 1").drop("_k")


def window_count(n: Column, config: EngineConfig = DEFAULT) -> Column:
    """How many windows n words have before a short last one is merged."""
    step = max(1, config.window_words - config.overlap_words)
    return F.when(n > 0, 1 + F.ceil(F.greatest(n - config.window_words, F.lit(0)) / step).cast("int")).otherwise(0)


def subchunks(chunks: DataFrame, *keys: str, config: EngineConfig = DEFAULT, text: str = "text", prefix: Column | None = None) -> DataFrame:
    """(keys, idx, text, word_count): overlapping windows of a text's words, each after the titles.

    A last window of too few words is added to the one before (which then repeats the overlap). A text without words
    is one window of the titles alone. Windows are made inside each row: nothing is shuffled.
    """
    size, step = config.window_words, max(1, config.window_words - config.overlap_words)
    prefix = title_prefix(F.col("chapter_title"), F.col("section_title")) if prefix is None else prefix
    rows = chunks.select(*keys, prefix.alias("_p"), words(F.coalesce(F.col(text), F.lit(""))).alias("_w")).withColumn("_k", window_count(F.size("_w"), config))
    rest = F.size("_w") - (F.col("_k") - 1) * step
    rows = rows.withColumn("_merge", (F.col("_k") > 1) & (rest < config.least_words))
    piece = lambda i: F.slice("_w", i * step + 1, F.lit(size))
    last = F.col("_k") - F.when(F.col("_merge"), 2).otherwise(1)
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(F.col("_merge") & (i == last), F.concat(piece(i), piece(i + 1))).otherwise(piece(i)))
    made = F.when(F.col("_k") > 0, made).otherwise(F.array(F.array().cast("array<string>")))
    each = rows.select(*keys, "_p", F.posexplode(made).alias("idx", "_x"))
    return each.select(*keys, "idx", strip(F.concat("_p", F.array_join("_x", " "))).alias("text"), F.size("_x").alias("word_count"))

"""Chapters, sections and headings, by windows over a document's entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import chapter_number, section_chapter_number, strip


def monotone_pages(entries: DataFrame, page: str = "pdf_page") -> DataFrame:
    """The entries (doc_key, seq, page) with a page not before any earlier one's; those without a page go."""
    before = Window.partitionBy("doc_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(page).over(before)
    return entries.where(F.col(page).isNotNull()).withColumn("_top", top).where(F.col("_top").isNull() | (F.col(page) >= F.col("_top"))).drop("_top")


def entry_ranges(entries: DataFrame) -> DataFrame:
    """The entries (doc_key, seq, pdf_page, page, num_pages) with ranges up to the next entry's page.

    page_start/page_end are 0-based, book_page_start/book_page_end the printed numbers.
    """
    order = Window.partitionBy("doc_key").orderBy("seq")
    end = F.greatest(F.col("pdf_page"), F.coalesce(F.lead("pdf_page").over(order), F.col("num_pages")) - 1)
    rows = entries.withColumn("page_start", F.col("pdf_page")).withColumn("page_end", end)
    following = F.lead("page").over(order)
    last = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("seq"))) == 1
    printed = F.when(last, F.col("page") + F.col("page_end") - F.col("page_start")).otherwise(F.greatest(F.col("page"), following - 1))
    return rows.withColumn("book_page_start", F.col("page")).withColumn("book_page_end", printed)


def number_chapters(ranges: DataFrame) -> DataFrame:
    """The ranged entries with chapter_no, starts (opens a chapter) and is_section.

    An entry of level 1 opens a chapter. A section label whose chapter number changes opens one too, unless the
    chapter at hand is an explicit one without a number.
    """
    order = Window.partitionBy("doc_key").orderBy("seq")
    rows = ranges.withColumn("_chap", F.when(F.col("level") <= 1, chapter_number(F.col("label")))).withColumn("_sec", F.when(F.col("level") > 1, section_chapter_number(F.col("label"))))
    rows = rows.withColumn("_seg", F.sum((F.col("level") <= 1).cast("int")).over(order))
    inside = Window.partitionBy("doc_key", "_seg").orderBy("seq")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.first("_chap").over(inside)).withColumn("_prev", F.last(F.coalesce("_chap", "_sec"), ignorenulls=True).over(earlier))
    leading = (F.col("_seg") == 0) & (F.row_number().over(order) == 1)
    changed = F.col("_sec").isNotNull() & ~F.col("_sec").eqNullSafe(F.col("_prev")) & ~((F.col("_seg") > 0) & F.col("_own").isNull())
    rows = rows.withColumn("starts", (F.col("level") <= 1) | leading | changed)
    rows = rows.withColumn("chapter_no", F.sum(F.col("starts").cast("int")).over(order))
    rows = rows.withColumn("is_section", (F.col("level") > 1) & ~(F.col("starts") & F.col("_sec").isNull()))
    made = F.col("starts") & F.col("is_section")
    return rows.withColumn("chapter_label", F.when(made, F.col("_sec")).when(F.col("starts"), F.col("label"))).withColumn("chapter_title", F.when(made, F.lit("")).when(F.col("starts"), F.col("title"))).drop("_chap", "_sec", "_seg", "_own", "_prev")


def build_chapters(ranges: DataFrame) -> DataFrame:
    """Chapters (doc_key, chapter_no, label, title, page ranges, sections) of the ranged entries.

    A chapter's end is the furthest end of its entries. Sections are in order of seq.
    """
    rows = number_chapters(ranges)
    section = F.struct("seq", "label", "title", "page_start", "page_end", "level", "book_page_start", "book_page_end")
    first = lambda c: F.min_by(c, "seq")
    return rows.groupBy("doc_key", "chapter_no").agg(
        F.max("chapter_label").alias("label"), F.max("chapter_title").alias("title"), first("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        first("book_page_start").alias("book_page_start"), F.max("book_page_end").alias("book_page_end"),
        F.array_sort(F.collect_list(F.when(F.col("is_section"), section))).alias("sections"),
    )


def lines_of_chars(chars: DataFrame) -> DataFrame:
    """Lines (doc_key, page_no, top, text, size) of characters (doc_key, page_no, char_seq, top, x0, size, text).

    Characters of one rounded height make a line, from left to right; its size is the mean of the sizes that are not 0.
    """
    placed = F.array_sort(F.collect_list(F.struct("x0", "char_seq", "text")))
    lines = chars.withColumn("top", F.bround("top", 0)).groupBy("doc_key", "page_no", "top").agg(placed.alias("c"), F.avg(F.nullif("size", F.lit(0.0))).alias("size"))
    return lines.select("doc_key", "page_no", "top", strip(F.array_join(F.col("c.text"), "")).alias("text"), F.coalesce("size", F.lit(0.0)).alias("size"))


def headings(chars: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Headings by size (doc_key, page_no, line_no, text, ratio, level): large lines among a page's first four."""
    # Size ratios of both levels, lines looked at, longest heading.
    first, second, lines_seen, longest = 1.6, 1.3, 4, 90
    lines = lines_of_chars(chars.where(F.col("page_no") < config.heading_pages))
    middle = lines.where("size > 0").groupBy("doc_key").agg(F.median("size").alias("middle"))
    lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_key", "page_no").orderBy("top")))
    lines = lines.where((F.col("line_no") <= lines_seen) & (F.col("text") != "") & (F.length("text") <= longest) & (F.col("size") > 0))
    rated = lines.join(middle, "doc_key").withColumn("ratio", F.col("size") / F.col("middle"))
    level = F.when(F.col("ratio") >= first, 1).when(F.col("ratio") >= second, 2)
    return rated.withColumn("level", level).where("level is not null").select("doc_key", "page_no", "line_no", "text", "ratio", "level")


def heading_entries(found: DataFrame) -> DataFrame:
    """Headings as entries for ranges and chapters: no label, the printed page one above the page."""
    seq = F.row_number().over(Window.partitionBy("doc_key").orderBy("page_no", "line_no")) - 1
    return found.select("doc_key", seq.alias("seq"), F.col("text").alias("raw_line"), F.lit("").alias("label"), F.col("text").alias("title"), (F.col("page_no") + 1).alias("page"), "level", F.col("page_no").alias("pdf_page"))


def usable_contents(contents: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_key) of the documents whose contents have enough entries, and one with a page."""
    counted = contents.groupBy("doc_key").agg(F.count("*").alias("n"), F.count("pdf_page").alias("placed"))
    return counted.where((F.col("n") >= config.toc_least_entries) & (F.col("placed") > 0)).select("doc_key")


def choose_entries(contents: DataFrame, font: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Entries of each document: of its contents if there are enough of them with a page, else by its headings; `by_font` tells."""
    usable = usable_contents(contents, config)
    kept = contents.join(usable, "doc_key", "left_semi").withColumn("by_font", F.lit(False))
    return kept.unionByName(font.join(usable, "doc_key", "left_anti").withColumn("by_font", F.lit(True)), allowMissingColumns=True)

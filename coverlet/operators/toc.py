"""Tables of contents: finding their pages, reading their entries, and where the entries' pages lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import patterns as P
from ..functions.fuzzy import partial_ratio_column
from ..functions.text import normalize, split_label, strip, words


def page_score(text: Column) -> Column:
    """How much a page looks like a table of contents, 0 to 100."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    n = F.size(lines)
    like = F.size(F.filter(lines, lambda x: strip(x).rlike(P.JAVA_TOC_LINE)))
    header = F.array_join(F.slice(lines, 1, 3), "\n").rlike(P.JAVA_CONTENTS)
    score = F.when(header, 45.0).otherwise(0.0) + F.least(F.lit(50.0), like / n * 100) + F.least(F.lit(15.0), like * 1.5)
    return F.when(n > 0, F.least(F.lit(100.0), score)).otherwise(0.0)


def toc_pages(scored: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_key, toc_start, toc_end) from (doc_key, page_no, score): the run with most hits, the first of equals.

    Runs of near hits are merged over larger gaps, which equals one pass with the larger of both gaps.
    """
    hits = scored.where((F.col("page_no") < config.toc_scan_pages) & (F.col("score") >= config.toc_least_score))
    order = Window.partitionBy("doc_key").orderBy("page_no")
    gap = F.col("page_no") - F.lag("page_no").over(order)
    run = F.sum((gap > max(config.toc_run_gap, config.toc_merge_gap)).cast("int")).over(order)
    runs = hits.withColumn("run", F.coalesce(run, F.lit(0))).groupBy("doc_key", "run").agg(F.min("page_no").alias("toc_start"), F.max("page_no").alias("toc_end"), F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("n"), "toc_start"))
    return runs.withColumn("best", best).where("best = 1").select("doc_key", "toc_start", "toc_end")


def _fold(state: Column, raw: Column) -> Column:
    line = strip(raw)
    pattern = F.when(line.rlike(P.JAVA_TOC_LEADER), F.lit(1)).when(line.rlike(P.JAVA_TOC_TRAILING), F.lit(2)).otherwise(0)
    part = lambda k: F.when(pattern == 1, F.regexp_extract(line, P.JAVA_TOC_LEADER, k)).otherwise(F.regexp_extract(line, P.JAVA_TOC_TRAILING, k))
    both = lambda text: F.when(state.pending != "", F.concat(state.pending, F.lit(" "), text)).otherwise(text)
    page = F.try_to_number(part(2), F.lit("9999")).cast("int")
    title = strip(F.regexp_replace(strip(both(strip(part(1), " ."))), P.JAVA_TOC_HEADER_LEAK, ""))
    entry = F.struct(raw.alias("raw_line"), title.alias("title"), page.alias("page"))
    longer = strip(both(line))
    made = lambda pending, entries: F.struct(pending.alias("pending"), entries.alias("entries"))
    return (
        F.when((line == "") | line.rlike(P.JAVA_TOC_NOISE), state)
        .when((pattern > 0) & ~F.coalesce(page.between(1, 4999), F.lit(False)), state)
        .when(pattern > 0, made(F.lit(""), F.when(title != "", F.array_append(state.entries, entry)).otherwise(state.entries)))
        .otherwise(made(F.when(F.size(words(longer)) > P.TOC_PENDING_WORDS, line).otherwise(longer), state.entries))
    )


def toc_entries(texts: DataFrame) -> DataFrame:
    """(doc_key, seq, raw_line, label, title, page, level) from each document's contents text.

    A line without a page number waits and is put before the next one's title; one fold over a document's lines.
    """
    start = F.struct(F.lit("").alias("pending"), F.array().cast("array<struct<raw_line:string,title:string,page:int>>").alias("entries"))
    folded = texts.select("doc_key", F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n"), start, _fold, lambda s: s.entries).alias("entries"))
    each = folded.select("doc_key", F.posexplode("entries").alias("seq", "e"))
    parts = each.select("doc_key", "seq", "e.raw_line", "e.page", split_label(F.col("e.title")).alias("l"))
    return parts.select("doc_key", "seq", "raw_line", "l.label", "l.title", "page", "l.level")


def page_offsets(entries: DataFrame, pages: DataFrame, config: EngineConfig = DEFAULT, score=partial_ratio_column) -> DataFrame:
    """The entries with `offset` and `pdf_page` (0-based, null when unresolved).

    Each entry's title is looked for at the heads of the pages that its printed number and each offset would give; the
    modal offset of confident entries holds for the document, a near offset of a very confident entry for itself.
    entries: (doc_key, seq, title, page, ...); pages: (doc_key, page_no, text).
    """
    heads = pages.select("doc_key", "page_no", normalize(F.substring(F.coalesce("text", F.lit("")), 1, config.anchor_chars)).alias("head"))
    counts = pages.groupBy("doc_key").agg((F.max("page_no") + 1).alias("num_pages"))
    tried = entries.select("doc_key", "seq", "page", normalize(F.col("title")).alias("wanted")).where("wanted <> ''")
    # Pages lie in bands as wide as the range of offsets, so an entry meets two bands and no other page of its document.
    width = config.offset_to - config.offset_from + 1
    band = lambda page_no: F.floor(page_no / width)
    least = F.col("page") - 1 + config.offset_from
    tried = tried.withColumn("band", F.explode(F.array_distinct(F.array(band(least), band(least + width - 1)))))
    off = F.col("page_no") - F.col("page") + 1
    scored = tried.join(heads.where("head <> ''").withColumn("band", band(F.col("page_no"))), ["doc_key", "band"])
    scored = scored.withColumn("off", off.cast("int")).where(F.col("off").between(config.offset_from, config.offset_to)).withColumn("score", score(F.col("wanted"), F.col("head"))).where("score > 0")
    best = scored.groupBy("doc_key", "seq").agg(F.max(F.struct("score", (-F.col("off")).alias("o"))).alias("b")).select("doc_key", "seq", F.col("b.score").alias("score"), (-F.col("b.o")).alias("own"))
    votes = best.where(F.col("score") >= config.anchor_score).groupBy("doc_key", "own").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    modal = votes.groupBy("doc_key").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "own")).alias("m")).select("doc_key", F.col("m.own").alias("everywhere"))
    rows = entries.join(best, ["doc_key", "seq"], "left").join(modal, "doc_key", "left").join(counts, "doc_key", "left").withColumn("everywhere", F.coalesce("everywhere", F.lit(0)))
    drifts = (F.col("score") >= config.drift_score) & (F.abs(F.col("own") - F.col("everywhere")) <= config.drift_pages)
    rows = rows.withColumn("offset", F.when(drifts, F.col("own")).otherwise(F.col("everywhere")))
    at = F.col("page") - 1 + F.col("offset")
    return rows.withColumn("pdf_page", F.when((at >= 0) & (at < F.col("num_pages")), at)).drop("score", "own", "everywhere", "num_pages")

"""Recommendations: the best passage of each cited book for each topic, and which of them to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import patterns as P
from ..functions.scoring import allows_unit, combine_scores, metadata_score, round1
from ..functions.text import coverage_label, semantic_query, stem_set, strip
from .passages import Asked
from .vectors import Encoder, encode

TOPIC = ("source_file", "code", "unit_seq", "topic_seq")


def with_stems(chunks: DataFrame) -> DataFrame:
    """The chunks with their title and the stem sets of title and body, made once a chunk."""
    title = strip(F.concat_ws(" ", "chapter_title", "section_title"))
    return chunks.withColumn("chunk_title", title).withColumn("title_stems", stem_set(F.col("chunk_title"))).withColumn("body_stems", stem_set(F.col("text")))


def keyword_overlaps(topics: DataFrame, chunks: DataFrame, topic: str | list[str], chunk: str | list[str]) -> DataFrame:
    """(topic, chunk, keyword) of the pairs that share a stem, by an index of stems instead of all pairs.

    topics: (topic, topic_stems); chunks: (chunk, title_stems, body_stems). Keys that both have must be equal. Pairs
    that are missing score 0.
    """
    topic, chunk = ([x] if isinstance(x, str) else x for x in (topic, chunk))
    keys = [*topic, *(c for c in chunk if c not in topic)]
    asked = topics.select(*topic, F.size("topic_stems").alias("n"), F.explode("topic_stems").alias("stem"))
    weighed = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("stem"), F.lit(w).alias("w")))
    index = chunks.select(*chunk, F.inline(F.concat(weighed(F.col("title_stems"), 2), weighed(F.array_except("body_stems", "title_stems"), 1))))
    hits = index.join(asked, ["stem", *(c for c in chunk if c in topic)]).groupBy(*keys, "n").agg(F.sum("w").alias("hits"))
    return hits.select(*keys, F.least(F.lit(1.0), F.col("hits") / (2 * F.col("n"))).alias("keyword"))


def best_passages(scored: DataFrame, topic: tuple[str, ...], book: str, order: tuple[str, ...], coverage: str = "coverage") -> DataFrame:
    """Each topic's best row of each book by unrounded coverage, the first by `order` of equals.

    The rows that cannot win are dropped before the shuffle by a partial aggregate over structs.
    """
    carried = [c for c in scored.columns if c not in (*topic, book, coverage, *order)]
    first = F.min_by(F.struct(*(F.col(c) for c in (coverage, *order, *carried))), F.struct((-F.col(coverage)).alias("c"), *order))
    return scored.groupBy(*topic, book).agg(first.alias("b")).select(*topic, book, "b.*")


def top_books(best: DataFrame, topic: tuple[str, ...], pool: str, coverage: str = "coverage", tie: str = "key_seq", config: EngineConfig = DEFAULT) -> DataFrame:
    """What to report of each topic: the first pool (0, 1, ...) with a passing book gives its best few, status Found;
    with none, the single best of all pools is Tentative if it reaches the lower bar."""
    rows = best.withColumn("_pass", F.col(coverage) >= config.found_percent)
    everyone = Window.partitionBy(*topic)
    rows = rows.withColumn("_pool", F.min(F.when(F.col("_pass"), F.col(pool))).over(everyone))
    rows = rows.withColumn("book_rank", F.row_number().over(Window.partitionBy(*topic, pool).orderBy(F.desc(coverage), tie)))
    rows = rows.withColumn("_any", F.row_number().over(everyone.orderBy(F.desc(coverage), pool, tie)))
    found = F.col("_pass") & (F.col(pool) == F.col("_pool")) & (F.col("book_rank") <= config.books_a_topic)
    tentative = F.col("_pool").isNull() & (F.col("_any") == 1) & (F.col(coverage) >= config.tentative_percent)
    rows = rows.withColumn("status", F.when(found, "Found").when(tentative, "Tentative"))
    return rows.where("status is not null").drop("_pass", "_pool", "_any")


def score_candidates(topics: DataFrame, cited: DataFrame, scopes: DataFrame, chunks: DataFrame, catalog: DataFrame, vectors: DataFrame, encoder: Encoder | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(topic keys, citation_type, key_seq, book_key, chunk_id, chunk_seq, coverage): each topic's best chunk of each cited book.

    topics: (TOPIC, unit_number, unit_title, topic); cited: (source_file, code, citation_type, book_key, key_seq); scopes:
    (source_file, code, book_key, scope); vectors: (book_key, chunk_id, embedding), one row a window. Each distinct query
    text is encoded once. Topics are the stated small side: what is asked of books goes to every task, and chunks are
    scored by blocks, so pairs are not shuffled but those that may be a book's best.
    """
    subject = ["source_file", "code"]
    asked = topics.withColumn("query", semantic_query(F.col("topic"), F.col("unit_title"))).where("query is not null")
    known = encode(asked.select("query").distinct(), encoder, "query", "query_embedding", config.query_prefix)
    texts = asked.select("topic", "query").distinct().join(known, "query").withColumn("topic_stems", stem_set(F.col("topic"))).toArrow()
    meta = catalog.select("book_key", metadata_score(*(F.col(c) for c in ("title", "authors", "edition", "year"))).alias("meta"))
    pairs = asked.select(*TOPIC, "unit_number", "topic", "query").join(cited, subject).join(scopes, [*subject, "book_key"], "left")
    pairs = pairs.withColumn("units", F.coalesce("scope.units", F.array().cast("array<int>"))).withColumn("sections", F.coalesce("scope.sections", F.array().cast("array<string>")))
    usable = chunks.groupBy("book_key").agg(F.collect_set("section_label").alias("labels"))
    pairs = pairs.join(meta, "book_key").join(usable, "book_key").withColumn("by_section", (F.size("sections") > 0) & F.arrays_overlap("sections", "labels"))
    unit = F.when(allows_unit(F.col("units"), F.col("unit_number")), 1.0).otherwise(config.out_of_unit)
    keys = [*TOPIC, "citation_type", "key_seq"]
    pairs = pairs.select(*keys, "book_key", "topic", "query", unit.alias("unit"), "sections", "by_section", "meta")
    held = Asked(pairs.toArrow(), texts, keys, config)

    windows = vectors.groupBy("book_key", "chunk_id").agg(F.collect_list("embedding").alias("embeddings"))
    rows = with_stems(chunks).select("book_key", "chunk_id", "chunk_seq", "section_label", "chunk_title", "title_stems", "body_stems").join(windows, ["book_key", "chunk_id"])
    kinds = dict(pairs.dtypes) | dict(rows.dtypes) | dict.fromkeys(("semantic", "keyword", "fuzzy", "section"), "double")
    names = [*keys, "book_key", "chunk_id", "chunk_seq", "semantic", "keyword", "fuzzy", "meta", "unit", "section"]
    rows = rows.mapInArrow(held.candidates, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    covers = combine_scores(*(F.col(c) for c in ("semantic", "keyword", "fuzzy", "meta")), config) * F.col("unit") * F.col("section")
    rows = rows.withColumn("coverage", covers).select(*keys, "book_key", "chunk_id", "chunk_seq", "coverage")
    best = best_passages(rows, (*TOPIC, "citation_type", "key_seq"), "book_key", ("chunk_id",))
    return best.withColumn("coverage", round1(F.col("coverage"), config))


def recommendations(subjects: DataFrame, topics: DataFrame, cited: DataFrame, chunks: DataFrame, catalog: DataFrame, best: DataFrame, unreadable: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The report's rows, at least one a topic; `seq` sorts them in report order.

    subjects: (source_file, subject_seq, code, name); best: as score_candidates gives it. Topics without a reported book get a Not Found row whose note
    says why, and which cited books had no text.
    """
    pooled = best.withColumn("pool", F.when(F.col("citation_type") == "textbook", 0).otherwise(1))
    chosen = top_books(pooled, TOPIC, "pool", config=config)
    told = chosen.join(catalog.select("book_key", "title", "authors", "edition", "publisher", "year", "book_type"), "book_key")
    told = told.join(chunks.select("book_key", "chunk_seq", "chapter_label", "chapter_title", "section_label", "section_title", "page_start", "page_end", "book_page_start", "book_page_end"), ["book_key", "chunk_seq"])
    has = cited.select("source_file", "code").distinct().withColumn("has_books", F.lit(True))
    rows = topics.join(subjects.select("source_file", "code", "subject_seq", "name"), ["source_file", "code"]).join(told, list(TOPIC), "left").join(has, ["source_file", "code"], "left").join(unreadable, ["source_file", "code"], "left")
    note = F.when(F.coalesce("has_books", F.lit(False)), P.NOTE_NOTHING_COVERS).otherwise(P.NOTE_NOTHING_RESOLVED)
    note = F.concat(note, F.when(F.col("unreadable").isNotNull(), F.concat(F.lit(P.NOTE_UNREADABLE[0]), F.col("unreadable"), F.lit(P.NOTE_UNREADABLE[1]))).otherwise(""))
    empty = lambda c: F.coalesce(c, F.lit(""))
    either = lambda a, b: F.when(empty(F.col(a)) != "", F.col(a)).otherwise(empty(F.col(b)))
    printed = lambda book, page: F.coalesce(F.col(book), F.col(page) + 1)
    order = F.struct("source_file", "subject_seq", "unit_seq", "topic_seq", F.coalesce("book_rank", F.lit(0)).alias("book_rank"))
    return rows.select(
        order.alias("seq"), F.element_at(F.split("source_file", "/"), -1).alias("syllabus_name"), F.col("code").alias("subject_code"), F.col("name").alias("subject_name"),
        module_number(F.col("unit_number"), F.col("unit_label")).alias("module_number"), F.col("unit_title").alias("module_title"), "topic", F.lit("").alias("sub_topic"), F.coalesce("status", F.lit("Not Found")).alias("status"),
        empty("title").alias("book_title"), empty("authors").alias("author"), empty("edition").alias("edition"), empty("publisher").alias("publisher"), empty("year").alias("year"), empty("book_type").alias("book_type"),
        strip(F.concat_ws(" ", either("section_label", "chapter_label"), either("section_title", "chapter_title"))).alias("chapter"),
        printed("book_page_start", "page_start").alias("page_start"), printed("book_page_end", "page_end").alias("page_end"), (F.col("page_start") + 1).alias("pdf_page_start"), (F.col("page_end") + 1).alias("pdf_page_end"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage_percent"), F.when(F.col("status").isNotNull(), coverage_label(F.col("coverage"))).otherwise(note).alias("notes"),
    )


def module_number(number: Column, label: Column) -> Column:
    """The unit's number, or its label where there is none or it is 0."""
    return F.when(F.coalesce(number, F.lit(0)) != 0, number.cast("string")).otherwise(label)

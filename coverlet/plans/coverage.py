"""The whole run: syllabi and books in, recommendations and summary out; and its focused and checking variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..log import LOG
from ..functions.text import file_stem, fix_ligatures
from ..operators import chapters as C
from ..operators import chunks as K
from ..operators import citations as Q
from ..operators import ranking as R
from ..operators import syllabus as Y
from ..operators import toc as O
from ..operators import vectors as V
from ..operators.metadata import extract_metadata
from ..operators.pages import range_text
from ..operators.reports import counters, summary
from ..sources.storage import stored

ENTRY = "doc_key string, seq int, raw_line string, label string, title string, page int, level int, pdf_page int"


@dataclass(frozen=True)
class Coverage:
    """What a run makes; each stage's table is written once, the report is computed when it is read."""

    subjects: DataFrame
    topics: DataFrame
    resolved: DataFrame
    catalog: DataFrame
    chapters: DataFrame
    chunks: DataFrame
    recommendations: DataFrame

    def summary(self) -> DataFrame:
        return summary(self.recommendations)

    def counters(self) -> DataFrame:
        return counters(self.subjects, self.topics, self.resolved, self.recommendations)


def catalog_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The books (doc_key, path, info_title, info_author) with metadata, from their first pages only, in order of path."""
    meta = extract_metadata(docs, pages).withColumnRenamed("doc_key", "book_key")
    # Catalog order decides ties only, so a number that sorts like the path is enough.
    ranked = meta.select("path").distinct().orderBy("path").withColumn("book_seq", F.monotonically_increasing_id())
    return meta.join(ranked, "path").withColumn("filename", F.element_at(F.split("path", "/"), -1))


#: Characters of books: a table, or what reads them for the books (doc_key) that need them.
Chars = DataFrame | Callable[[DataFrame], DataFrame] | None


def book_chapters(pages: DataFrame, chars: Chars = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chapters of every book: by its table of contents, else by the sizes of its lines where `chars` has them.

    Characters are only asked for of books without usable contents.
    """
    front = pages.where(F.col("page_no") < config.toc_scan_pages)
    found = O.toc_pages(front.select("doc_key", "page_no", O.page_score(F.col("text")).alias("score")), config)
    texts = range_text(found.withColumn("k", F.lit(0)), pages, "k", "toc_start", "toc_end")
    entries = O.page_offsets(stored(O.toc_entries(texts.select("doc_key", "text")), "entries"), pages, config)
    contents = entries.select("doc_key", "seq", "raw_line", "label", "title", "page", "level", F.col("pdf_page").cast("int").alias("pdf_page"))
    contents = stored(contents, "contents")
    if chars is None:
        by_font = pages.sparkSession.createDataFrame([], ENTRY)
    else:
        needed = pages.select("doc_key").distinct().join(C.usable_contents(contents, config), "doc_key", "left_anti")
        chars = chars(needed) if callable(chars) else chars.join(needed, "doc_key", "left_semi")
        by_font = C.heading_entries(C.headings(chars, config)).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in ENTRY.split(", ")))
    chosen = stored(C.choose_entries(contents, by_font, config), "chosen")
    sizes = pages.groupBy("doc_key").agg((F.max("page_no") + 1).cast("int").alias("num_pages"))
    return C.build_chapters(C.entry_ranges(C.monotone_pages(chosen).join(sizes, "doc_key")))


def pick_subjects(subjects: DataFrame, codes: list[str] | None) -> DataFrame:
    """The subjects with one of the codes, in any case; all of them for None."""
    return subjects if codes is None else subjects.where(F.upper("code").isin([c.upper() for c in codes]))


def pick_books(docs: DataFrame, names: list[str] | None) -> DataFrame:
    """The books with one of the names (file name or its stem); an error names those that are missing."""
    if names is None:
        return docs
    wanted = docs.sparkSession.createDataFrame([(n, n.rsplit("/", 1)[-1]) for n in names], "name string, file string").withColumn("doc_key", F.when(F.lower("file").rlike("[.]pdf$"), file_stem(F.col("file"))).otherwise(F.col("file")))
    missing = [r.name for r in wanted.join(docs.select("doc_key"), "doc_key", "left_anti").collect()]
    if missing:
        raise ValueError(f"no such book: {', '.join(sorted(missing))}")
    return docs.join(F.broadcast(wanted.select("doc_key").distinct()), "doc_key", "left_semi")


def map_coverage(syllabi: DataFrame, docs: DataFrame, pages: DataFrame, chars: Chars = None, encoder: V.Encoder | None = None, codes: list[str] | None = None, books: list[str] | None = None, config: EngineConfig = DEFAULT) -> Coverage:
    """Recommendations for syllabi (source_file, text) from books: docs (doc_key, path, info_title, info_author), pages
    (doc_key, page_no, text) and characters (doc_key, page_no, char_seq, top, x0, size, text).

    With `codes` or `books` the run is a focused one: filters and semi-joins come first, so only cited books are
    split and embedded. Null texts of syllabi give no subjects, null pages are empty.
    """
    standard = stored(Y.standardize(syllabi.where("text is not null")).select("source_file", "text"), "standard")
    subjects = stored(pick_subjects(Y.subjects(standard), codes), "subjects")
    topics = stored(Y.explode_topics(Y.units(subjects)), "topics")
    docs = pick_books(docs, books)
    pages = pages.join(docs.select("doc_key"), "doc_key", "left_semi").select("doc_key", "page_no", fix_ligatures(F.coalesce("text", F.lit(""))).alias("text"))
    pages = stored(pages, "pages")
    catalog = stored(catalog_of(docs, pages), "catalog")
    resolved = stored(Q.resolve(Y.cited_books(subjects), catalog, config), "resolved")
    wanted = Q.cited_only(docs.select(F.col("doc_key").alias("book_key")), resolved).withColumnRenamed("book_key", "doc_key")
    used = pages.join(wanted, "doc_key", "left_semi")
    chapters = stored(book_chapters(used, chars, config), "chapters")
    # Windows come from all chunks; of chunks with one id the last one's text and pages stand in the report.
    chunks = stored(K.chunk_texts(K.flatten_chapters(chapters), used, config), "chunks")
    cited, scopes = Q.cited_keys(resolved, "source_file", "code"), Q.book_scopes(resolved, "source_file", "code")
    windows = K.subchunks(chunks, "book_key", "chunk_id", config=config).select("book_key", "chunk_id", "text")
    vectors = V.encode_cached(windows, config.cache_dir, encoder) if config.cache_dir else V.encode(windows, encoder)
    vectors = vectors.select("book_key", "chunk_id", "embedding")
    last = K.last_of_id(chunks)
    best = stored(R.score_candidates(topics, cited, scopes, last, catalog, vectors, encoder, config), "best")
    missing = Q.unreadable(resolved, catalog, chunks, "source_file", "code")
    rows = R.recommendations(subjects, topics, cited, last, catalog, best, missing, config)
    return Coverage(subjects, topics, resolved, catalog, chapters, chunks, rows)


def calibrate(run: Coverage, encoder: V.Encoder | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Percentiles of the topics' best raw similarities over their candidate books: textbooks, else references."""
    keys = Q.cited_keys(run.resolved, "source_file", "code")
    books = keys.where("citation_type = 'textbook'")
    others = keys.where("citation_type <> 'textbook'").join(books.select("source_file", "code"), ["source_file", "code"], "left_anti")
    vectors = V.encode(K.subchunks(run.chunks, "book_key", "chunk_id", config=config).select("book_key", "text"), encoder).select("book_key", "embedding")
    asked = run.topics.select(*R.TOPIC, "topic").join(books.unionByName(others).select("source_file", "code", "book_key"), ["source_file", "code"])
    known = V.encode(asked.select("topic").distinct(), encoder, "topic", "query_embedding", config.query_prefix)
    return V.calibration(V.similarities(asked.join(known, "topic"), vectors, ["book_key"]), *R.TOPIC)


def read_syllabi(files: DataFrame, reader) -> DataFrame:
    """(source_file, text) of files (path, content): all pages joined; a file that cannot be read has a null text."""
    from ..operators.pages import full_text
    from ..sources.tables import read_pages

    keyed = files.select(F.col("path").alias("doc_key"), "content")
    texts = full_text(read_pages(keyed, reader).where("error is null"))
    return files.select(F.col("path").alias("doc_key")).join(texts, "doc_key", "left").withColumnRenamed("doc_key", "source_file")


def run_folders(spark: SparkSession, config: EngineConfig = DEFAULT, extension: str = ".pdf", reader=None, encoder: V.Encoder | None = None, codes: list[str] | None = None, books: list[str] | None = None, info_reader=None, char_reader=None) -> Coverage:
    """A run over a folder of books (not its subfolders) and one of syllabi (with them).

    Without readers files are PDF files, with information entries, and with characters where their library is there.
    Books that cannot be read are told in the log and left out.
    """
    from ..sources.tables import find_files, pdf_chars, pdf_info, pdf_pages, read_chars, read_info, read_pages

    if reader is None:
        reader, info_reader = pdf_pages, info_reader or pdf_info
        char_reader = char_reader or (pdf_chars if find_spec("pdfplumber") else None)
    if char_reader is None:
        LOG.info("no reader of characters: books without a table of contents get no chapters")
    syllabi = read_syllabi(find_files(spark, config.syllabi_dir, extension), reader)
    files = find_files(spark, config.books_dir, extension, recursive=False).withColumn("doc_key", file_stem(F.col("path")))
    docs = stored(read_info(files, info_reader), "docs")
    read = stored(read_pages(files, reader), "read")
    failed = read.where("error is not null")
    if lost := failed.count():
        shown = "; ".join(f"{r.doc_key} ({r.error})" for r in failed.select("doc_key", "error").orderBy("doc_key").limit(20).collect())
        LOG.warning("%d books could not be read, among them: %s", lost, shown)
    chars = None if char_reader is None else lambda needed: read_chars(files.join(needed, "doc_key", "left_semi"), char_reader, config.heading_pages)
    return map_coverage(syllabi, docs, read.where("error is null").drop("error"), chars, encoder, codes, books, config)

"""Queries of page, contents, chapter and chunk operators, on texts rendered from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chapters as C
from ..operators import chunks as K
from ..operators import pages as G
from ..operators import toc as O
from ..sources.tables import table
from .registry import query


def _conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation as a book, its turns as pages."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_key"), F.col("turn").cast("int").alias("page_no"), "text")


@query("SELECT conv_id AS doc_key, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def page_concat(spark: SparkSession, folder: str) -> DataFrame:
    return G.full_text(_conversation_pages(spark, folder))


@query("""
WITH r AS (SELECT DISTINCT conv_id AS doc_key, CAST(conv_id % 5 AS INTEGER) AS page_start, CAST(conv_id % 5 + 2 AS INTEGER) AS page_end FROM conversations)
SELECT r.doc_key, page_start, page_end, coalesce(string_agg(c.text, chr(10) ORDER BY c.turn) FILTER (c.text IS NOT NULL), '') AS text
FROM r LEFT JOIN conversations c ON c.conv_id = r.doc_key AND c.turn BETWEEN page_start AND least(page_end, page_start + 1) GROUP BY ALL
""")
def page_range_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _conversation_pages(spark, folder)
    start = (F.col("doc_key") % 5).cast("int")
    ranges = pages.select("doc_key", start.alias("page_start"), (start + 2).alias("page_end")).distinct().withColumn("k", F.lit(0))
    return G.range_text(ranges, pages, "k", most=2).drop("k")


@query("SELECT conv_id AS doc_key, CAST(turn AS INTEGER) AS page_no, text FROM conversations WHERE turn BETWEEN 1 AND 3")
def pages_between(spark: SparkSession, folder: str) -> DataFrame:
    return G.pages_between(_conversation_pages(spark, folder), 1, 3)


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """An order as a document, its lines as contents entries whose pages run with the quantity."""
    lines = table(spark, folder, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    lines = lines.withColumn("seq", seq)
    page = F.sum(F.col("l_quantity")).over(Window.partitionBy("l_orderkey").orderBy("seq")).cast("int")
    return lines.withColumn("page", page)


_SQL_LINES = """
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS seq FROM lineitem),
l AS (SELECT *, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY seq) AS INTEGER) AS page FROM n)
"""


def _toc_page(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines as a page: a line with a page number for each large enough quantity, else prose."""
    line = F.when(F.col("l_quantity") > 15, F.concat(F.lit("Entry number "), "l_linenumber", F.lit(" .... "), "page")).otherwise("just prose here")
    text = F.array_sort(F.collect_list(F.struct("seq", line.alias("t"))))
    rows = _order_lines(spark, folder).groupBy("l_orderkey").agg(F.array_join(F.transform(text, lambda r: r.t), "\n").alias("body"))
    return rows.select("l_orderkey", F.concat(F.when(F.col("l_orderkey") % 7 == 0, F.lit("Table of  Contents\n")).otherwise(""), "body").alias("text"))


_SQL_PAGE_SCORE = f"""
{_SQL_LINES},
s AS (SELECT l_orderkey, count(*) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n, count_if(l_quantity > 15) AS k FROM l GROUP BY l_orderkey),
score AS (SELECT l_orderkey, CAST(least(100.0, CASE WHEN l_orderkey % 7 = 0 THEN 45.0 ELSE 0.0 END + least(50.0, k / n * 100.0) + least(15.0, k * 1.5)) AS DOUBLE) AS score FROM s)
"""


@query(f"WITH {_SQL_PAGE_SCORE} SELECT l_orderkey, round(score, 6) AS score FROM score")
def toc_page_score(spark: SparkSession, folder: str) -> DataFrame:
    return _toc_page(spark, folder).select("l_orderkey", F.round(O.page_score(F.col("text")), 6).alias("score"))


@query(f"""
WITH {_SQL_PAGE_SCORE},
p AS (SELECT l_orderkey // 40 AS doc_key, l_orderkey % 40 AS page_no FROM score WHERE score >= 35),
g AS (SELECT *, CASE WHEN page_no - lag(page_no) OVER w > 6 THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY doc_key ORDER BY page_no)),
r AS (SELECT doc_key, page_no, sum(new) OVER (PARTITION BY doc_key ORDER BY page_no) AS run FROM g),
a AS (SELECT doc_key, min(page_no) AS toc_start, max(page_no) AS toc_end, count(*) AS n FROM r GROUP BY doc_key, run)
SELECT doc_key, toc_start, toc_end FROM a QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY n DESC, toc_start) = 1
""")
def toc_page_runs(spark: SparkSession, folder: str) -> DataFrame:
    pages = _toc_page(spark, folder).select(F.expr("l_orderkey div 40").alias("doc_key"), (F.col("l_orderkey") % 40).alias("page_no"), O.page_score(F.col("text")).alias("score"))
    return O.toc_pages(pages)


def _toc_text(spark: SparkSession, folder: str, wrapped: bool) -> DataFrame:
    """Contents lines with noise between; wrapped: titles of odd lines continue on a second line."""
    title = F.concat(F.lit("Title "), F.col("l_partkey"), F.lit("x"))
    first = F.concat("l_linenumber", F.lit("."), "seq", F.lit(" "), title)
    plain = F.concat(first, F.when(F.col("seq") % 2 == 0, F.lit(" ...... ")).otherwise("   "), "page", F.lit("  "))
    broken = F.concat(first, F.lit("\niv\n\nand more "), F.lit("….… "), "page")
    line = F.when((F.col("l_linenumber") % 2 == 1) & F.lit(wrapped), broken).otherwise(plain)
    rows = _order_lines(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))).alias("x"))
    return rows.select(F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("CONTENTS\n12\n"), F.array_join(F.transform("x", lambda r: r.t), "\n"), F.lit("\n99999 ... 12345\nend")).alias("text"))


_SQL_TOC = f"""
WITH {_SQL_LINES}
SELECT l_orderkey AS doc_key, seq, l_linenumber || '.' || seq AS label, 'Title ' || l_partkey || 'x' || {{more}} AS title, page, CAST(2 AS INTEGER) AS level FROM l
"""


@query(_SQL_TOC.format(more="''"))
def toc_parse_simple(spark: SparkSession, folder: str) -> DataFrame:
    return O.toc_entries(_toc_text(spark, folder, False)).drop("raw_line")


@query(_SQL_TOC.format(more="CASE WHEN l_linenumber % 2 = 1 THEN ' and more' ELSE '' END"))
def toc_parse_wrapped(spark: SparkSession, folder: str) -> DataFrame:
    return O.toc_entries(_toc_text(spark, folder, True)).drop("raw_line")


def _offset_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the orders, and pages at a third of the orders' own offset; every seventh line's page lies one further."""
    rows = _order_lines(spark, folder).withColumn("title", F.concat(F.lit("head "), "l_partkey"))
    at = F.col("page") - 1 + (F.col("l_orderkey") % 3).cast("int") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)
    entries = rows.select(F.col("l_orderkey").alias("doc_key"), "seq", "title", "page")
    last = rows.groupBy(F.col("l_orderkey").alias("doc_key")).agg((F.max("page") + 1).alias("page_no")).withColumn("text", F.lit(""))
    return entries, rows.select(F.col("l_orderkey").alias("doc_key"), at.alias("page_no"), F.col("title").alias("text")).unionByName(last).groupBy("doc_key", "page_no").agg(F.max("text").alias("text"))


def _equal(a, b):
    return F.when(a == b, 100.0).otherwise(0.0)


_SQL_OFFSET = f"""
WITH {_SQL_LINES},
r AS (SELECT l_orderkey AS doc_key, seq, 'head ' || l_partkey AS title, page, page - 1 + CAST(l_orderkey % 3 AS INTEGER) + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS pos FROM l),
p0 AS (SELECT doc_key, pos AS page_no, title AS text FROM r UNION ALL SELECT doc_key, max(page) + 1, '' FROM r GROUP BY doc_key),
p AS (SELECT doc_key, page_no, max(text) AS text FROM p0 GROUP BY ALL),
best AS (SELECT r.doc_key, r.seq, min(p.page_no - r.page + 1) AS own FROM r JOIN p ON p.doc_key = r.doc_key AND p.text = r.title AND p.page_no - r.page + 1 BETWEEN -3 AND 45 GROUP BY ALL),
votes AS (SELECT doc_key, own, count(*) AS n, min(seq) AS first FROM best GROUP BY ALL),
modal AS (SELECT doc_key, own AS everywhere FROM votes QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY n DESC, first) = 1),
cnt AS (SELECT doc_key, max(page_no) + 1 AS num_pages FROM p GROUP BY doc_key),
o AS (SELECT r.doc_key, r.seq, r.title, r.page, CAST(CASE WHEN abs(own - coalesce(everywhere, 0)) <= 3 THEN own ELSE coalesce(everywhere, 0) END AS INTEGER) AS "offset", num_pages
    FROM r LEFT JOIN best USING (doc_key, seq) LEFT JOIN modal USING (doc_key) LEFT JOIN cnt USING (doc_key))
SELECT doc_key, seq, title, page, "offset", CASE WHEN page - 1 + "offset" >= 0 AND page - 1 + "offset" < num_pages THEN page - 1 + "offset" END AS pdf_page FROM o
"""


@query(_SQL_OFFSET)
def page_offset_mode(spark: SparkSession, folder: str) -> DataFrame:
    """With exact likeness, so that SQL can follow."""
    return O.page_offsets(*_offset_tables(spark, folder), score=_equal)


@query()
def page_offset_drift(spark: SparkSession, folder: str) -> DataFrame:
    """With partial likeness of titles and page heads."""
    return O.page_offsets(*_offset_tables(spark, folder))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved entries with backward steps and missing pages."""
    rows = _order_lines(spark, folder)
    pdf = F.when(F.col("l_linenumber") % 5 == 0, None).when(F.col("l_returnflag") == "R", F.col("page") - 30).otherwise(F.col("page"))
    level = F.when(F.col("l_returnflag") == "A", 1).otherwise(2)
    label = F.when(level == 1, F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Chapter "), "l_linenumber")).otherwise("")).when(F.col("l_quantity") > 10, F.concat((F.col("l_partkey") % 3).cast("string"), F.lit("."), "l_linenumber")).otherwise("")
    return rows.select(F.col("l_orderkey").alias("doc_key"), "seq", label.alias("label"), F.concat(F.lit("T"), "l_suppkey").alias("title"), "page", level.alias("level"), pdf.alias("pdf_page"), F.lit(400).alias("num_pages"))


_SQL_ENTRIES = f"""
{_SQL_LINES},
e AS (SELECT l_orderkey AS doc_key, seq, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'Chapter ' || l_linenumber ELSE '' END WHEN l_quantity > 10 THEN (l_partkey % 3) || '.' || l_linenumber ELSE '' END AS label,
    'T' || l_suppkey AS title, page, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS level, CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_returnflag = 'R' THEN page - 30 ELSE page END AS pdf_page, 400 AS num_pages FROM l),
m AS (SELECT * FROM (SELECT *, max(pdf_page) OVER (PARTITION BY doc_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) WHERE pdf_page IS NOT NULL AND (top IS NULL OR pdf_page >= top)),
x AS (SELECT *, pdf_page AS page_start, greatest(pdf_page, coalesce(lead(pdf_page) OVER w, num_pages) - 1) AS page_end, page AS book_page_start, lead(page) OVER w AS following, lead(seq) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY doc_key ORDER BY seq)),
r AS (SELECT *, CASE WHEN last THEN page + page_end - page_start ELSE greatest(page, following - 1) END AS book_page_end FROM x)
"""


@query(f"WITH {_SQL_ENTRIES} SELECT doc_key, seq, label, pdf_page FROM m")
def monotone_pages(spark: SparkSession, folder: str) -> DataFrame:
    return C.monotone_pages(_entries(spark, folder)).select("doc_key", "seq", "label", "pdf_page")


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    return C.entry_ranges(C.monotone_pages(_entries(spark, folder)))


@query(f"WITH {_SQL_ENTRIES} SELECT doc_key, seq, page_start, page_end, book_page_start, book_page_end FROM r")
def entry_page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return _ranges(spark, folder).select("doc_key", "seq", "page_start", "page_end", "book_page_start", "book_page_end")


_SQL_CHAPTERS = f"""
{_SQL_ENTRIES},
a AS (SELECT *, CASE WHEN level <= 1 THEN nullif(regexp_extract(label, '(\\d+)\\s*$', 1), '') END AS chap, CASE WHEN level > 1 THEN nullif(regexp_extract(label, '^(\\d+)\\.\\d', 1), '') END AS sec,
    sum(CASE WHEN level <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY seq) AS seg FROM r),
b AS (SELECT *, first_value(chap) OVER w AS own, last_value(coalesce(chap, sec) IGNORE NULLS) OVER (PARTITION BY doc_key, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    row_number() OVER (PARTITION BY doc_key ORDER BY seq) AS k FROM a WINDOW w AS (PARTITION BY doc_key, seg ORDER BY seq)),
c AS (SELECT *, level <= 1 OR (seg = 0 AND k = 1) OR (sec IS NOT NULL AND sec IS DISTINCT FROM prev AND NOT (seg > 0 AND own IS NULL)) AS starts FROM b),
d AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY seq) AS chapter_no, level > 1 AND NOT (starts AND sec IS NULL) AS is_section FROM c),
ch AS (SELECT doc_key, chapter_no, max(CASE WHEN starts AND is_section THEN sec WHEN starts THEN label END) AS label, max(CASE WHEN starts AND is_section THEN '' WHEN starts THEN title END) AS title,
    arg_min(page_start, seq) AS page_start, max(page_end) AS page_end, count_if(is_section) AS n_sections, coalesce(string_agg(label || '@' || page_start, ',' ORDER BY seq) FILTER (is_section), '') AS sections FROM d GROUP BY ALL)
"""


@query(f"WITH {_SQL_CHAPTERS} SELECT doc_key, CAST(chapter_no AS BIGINT) AS chapter_no, label, title, page_start, page_end, CAST(n_sections AS INTEGER) AS n_sections, sections FROM ch")
def chapter_build(spark: SparkSession, folder: str) -> DataFrame:
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s.label, F.lit("@"), s.page_start)), ",")
    return C.build_chapters(_ranges(spark, folder)).select("doc_key", "chapter_no", "label", "title", "page_start", "page_end", F.size("sections").alias("n_sections"), sections.alias("sections"))


def _chars(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as characters: an order's supplier parts make lines, the quantity is the size."""
    rows = table(spark, folder, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    size = F.when(F.col("l_linenumber") % 6 == 0, 0.0).otherwise(F.col("l_quantity"))
    return rows.select(F.expr("l_orderkey div 400").alias("doc_key"), (F.col("l_orderkey") % 400).alias("page_no"), n.alias("char_seq"), (F.col("l_suppkey") % 6 + F.col("l_discount")).alias("top"), F.col("l_extendedprice").alias("x0"), size.alias("size"), F.concat("l_returnflag", "l_linestatus").alias("text"))


_SQL_CHARS = """
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS char_seq FROM lineitem),
c AS (SELECT l_orderkey // 400 AS doc_key, l_orderkey % 400 AS page_no, char_seq, round_even(l_suppkey % 6 + l_discount, 0) AS top, l_extendedprice AS x0, CASE WHEN l_linenumber % 6 = 0 THEN 0.0 ELSE l_quantity END AS size, l_returnflag || l_linestatus AS text FROM n),
l AS (SELECT doc_key, page_no, top, string_agg(text, '' ORDER BY x0, char_seq) AS text, coalesce(avg(nullif(size, 0)), 0.0) AS size FROM c GROUP BY ALL)
"""


@query(f"WITH {_SQL_CHARS} SELECT doc_key, page_no, top, text, round(size, 6) AS size FROM l")
def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    return C.lines_of_chars(_chars(spark, folder)).withColumn("size", F.round("size", 6))


@query(f"""
WITH {_SQL_CHARS},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_key, page_no ORDER BY top) AS line_no FROM l WHERE page_no < 500),
m AS (SELECT doc_key, median(size) AS middle FROM k WHERE size > 0 GROUP BY doc_key)
SELECT doc_key, page_no, CAST(line_no AS INTEGER) AS line_no, text, round(size / middle, 6) AS ratio, CASE WHEN size / middle >= 1.6 THEN 1 ELSE 2 END AS level FROM k JOIN m USING (doc_key)
WHERE line_no <= 4 AND length(text) <= 90 AND size > 0 AND size / middle >= 1.3
""")
def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    return C.headings(_chars(spark, folder)).withColumn("ratio", F.round("ratio", 6))


_SQL_FLAT = f"""
{_SQL_CHAPTERS},
f AS (SELECT d.doc_key, d.chapter_no, d.seq, ch.label AS chapter_label, d.label AS section_label, d.title AS section_title, d.page_start, d.page_end FROM d JOIN ch USING (doc_key, chapter_no) WHERE is_section
    UNION ALL SELECT doc_key, chapter_no, NULL, label, '', '', page_start, page_end FROM ch WHERE n_sections = 0),
flat AS (SELECT doc_key AS book_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY chapter_no, seq NULLS FIRST) - 1 AS INTEGER) AS chunk_seq,
    doc_key || '::' || chapter_label || '::' || CASE WHEN seq IS NULL THEN '_' WHEN section_label <> '' THEN section_label ELSE section_title END AS chunk_id, section_label, section_title, page_start, page_end FROM f)
"""


@query(f"WITH {_SQL_FLAT} SELECT * FROM flat")
def chunk_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return K.flatten_chapters(C.build_chapters(_ranges(spark, folder))).select("book_key", "chunk_seq", "chunk_id", "section_label", "section_title", "page_start", "page_end")


@query(f"WITH {_SQL_FLAT} SELECT book_key, chunk_id, max(chunk_seq) AS chunk_seq FROM flat GROUP BY ALL")
def chunk_id_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return K.last_of_id(K.flatten_chapters(C.build_chapters(_ranges(spark, folder)))).select("book_key", "chunk_id", "chunk_seq")


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(replace(text, ' e', chr(160) || 'e'), ' d', chr(8195) || 'd'), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, CAST(CASE WHEN len(w) = 0 THEN 1 ELSE 1 + ceil(greatest(len(w) - 350, 0) / 300.0) END AS BIGINT))) AS idx FROM w)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, trim('Head. ' || array_to_string(w[idx * 300 + 1:idx * 300 + 350], ' ')) AS text, CAST(len(w[idx * 300 + 1:idx * 300 + 350]) AS INTEGER) AS word_count FROM i
""")
def subchunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of texts some of whose spaces are no-break or em spaces."""
    text = F.replace(F.replace("text", F.lit(" e"), F.lit("\u00a0e")), F.lit(" d"), F.lit("\u2003d"))
    return K.subchunks(table(spark, folder, "documents").withColumn("text", text), "doc_id", prefix=F.lit("Head. "))


@query()
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as books: chapters of three turns, their text from the pages."""
    pages = _conversation_pages(spark, folder)
    flat = pages.groupBy("doc_key", F.expr("page_no div 3").cast("int").alias("chunk_seq")).agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end")).withColumnRenamed("doc_key", "book_key")
    return K.chunk_texts(flat, pages)

"""Queries of the syllabus parsers, on texts rendered from rows so that the rows say what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import int_to_roman
from ..operators import syllabus as Y
from ..sources.tables import table
from .registry import query


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each customer's orders: a subject with units (orders) and topics (lines)."""
    orders = table(spark, folder, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = orders.withColumn("unit", k)
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = table(spark, folder, "lineitem").withColumn("n", n)
    return lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "unit"), "l_orderkey").select("o_custkey", "unit", "n", "l_partkey", "l_suppkey")


_SQL_LINES = """
o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS unit FROM orders),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
l AS (SELECT o_custkey, unit, n, l_partkey, l_suppkey FROM x JOIN o ON o_orderkey = l_orderkey)
"""


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """A syllabus a customer, in non-standard wording for every third one."""
    odd = F.col("o_custkey") % 3 == 0
    topic = F.concat(F.lit("topic "), F.col("l_partkey"), F.lit(" of "), F.col("l_suppkey"))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), c.alias("t")))), lambda r: r.t), "{}")
    units = _lines(spark, folder).groupBy("o_custkey", "unit").agg(F.array_sort(F.collect_list(F.struct("n", topic.alias("t")))).alias("t"))
    head = F.concat(F.when(odd, F.lit("MODULE ")).otherwise("UNIT "), int_to_roman(F.col("unit")), F.lit(" BASIC PART "), F.when(odd, F.lit("9")).otherwise(" 9 + 3"))
    body = F.when(odd, F.concat(F.lit("\n•"), F.array_join(F.transform("t", lambda r: r.t), "\n • "))).otherwise(F.concat(F.lit("\n"), F.array_join(F.transform("t", lambda r: r.t), " –\n ")))
    units = units.select("o_custkey", "unit", F.concat(head, body, F.lit(" .\n")).alias("text"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda r: r.text), "")
    rows = units.groupBy("o_custkey").agg(parts.alias("units"))
    code = F.concat(F.when(odd, F.lit("PTME")).otherwise("ME"), F.lpad((F.col("o_custkey") % 9000 + 1000).cast("string"), 4, "0"))
    goal = F.when(odd, F.lit("\nAIM:\n")).otherwise("\nCOURSE OBJECTIVES: x\n")
    books = F.concat(F.when(odd, F.lit("Prescribed Text Books\n")).otherwise("TEXT BOOKS:\n"), F.lit("1. Maker "), F.col("o_custkey"), F.lit(', "Parts",\n 2019.\n2) Other A, "Rest".\n3 \n'), F.when(odd, F.lit("BIBLIOGRAPHY\n")).otherwise("REFERENCES\n"), F.lit("1 Third B, Press, 2001. OUTCOMES: y\n4. not this\n"))
    return rows.select("o_custkey", F.concat(F.lit("c/"), "o_custkey", F.lit(".pdf")).alias("source_file"), F.concat(F.lit("LM317 is a part number\n" + "filler " * 80), code, F.lit("  - NAME OF "), F.col("o_custkey"), F.lit(" L T P C\n"), goal, "units", books).alias("text"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return Y.subjects(Y.standardize(_texts(spark, folder).drop("o_custkey")).select("source_file", "text"))


_SQL_UNITS = f"{_SQL_LINES}, u AS (SELECT 'c/' || o_custkey || '.pdf' AS source_file, 'ME' || (o_custkey % 9000 + 1000) AS code, o_custkey, unit, n, 'topic ' || l_partkey || ' of ' || l_suppkey AS topic, dense_rank() OVER (PARTITION BY o_custkey ORDER BY unit) - 1 AS unit_seq FROM l)"


@query(f"WITH {_SQL_UNITS} SELECT DISTINCT source_file, CAST(0 AS INTEGER) AS subject_seq, code, 'NAME OF ' || o_custkey AS name FROM u")
def course_starts(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).drop("block")


@query(f"WITH {_SQL_UNITS} SELECT source_file, code, CAST(unit_seq AS INTEGER) AS unit_seq, CAST(unit AS INTEGER) AS unit_number, 'BASIC PART' AS unit_title, string_agg(topic, '|' ORDER BY n) AS topics FROM u GROUP BY ALL")
def unit_parse(spark: SparkSession, folder: str) -> DataFrame:
    return Y.units(_subjects(spark, folder)).select("source_file", "code", "unit_seq", "unit_number", "unit_title", F.array_join("topics", "|").alias("topics"))


@query(f"WITH {_SQL_UNITS} SELECT source_file, code, CAST(unit_seq AS INTEGER) AS unit_seq, CAST(n - 1 AS INTEGER) AS topic_seq, topic FROM u")
def topic_explode(spark: SparkSession, folder: str) -> DataFrame:
    return Y.explode_topics(Y.units(_subjects(spark, folder))).select("source_file", "code", "unit_seq", "topic_seq", "topic")


@query(f"""
WITH {_SQL_UNITS}, c AS (SELECT DISTINCT source_file, code, o_custkey FROM u)
SELECT source_file, code, CAST(0 AS INTEGER) AS cite_seq, 'Maker ' || o_custkey || ', "Parts", 2019.' AS raw_line, 'textbook' AS citation_type FROM c
UNION ALL SELECT source_file, code, 1, 'Other A, "Rest". 3', 'textbook' FROM c UNION ALL SELECT source_file, code, 2, '1 Third B, Press, 2001.', 'reference' FROM c
""")
def cited_books_parse(spark: SparkSession, folder: str) -> DataFrame:
    return Y.cited_books(_subjects(spark, folder))


@query(f"""
WITH {_SQL_LINES}, c AS (SELECT o_custkey, count(*) AS topics, count(DISTINCT unit) AS units FROM l GROUP BY o_custkey)
SELECT 'c/' || o_custkey || '.pdf' AS source_file, CASE WHEN o_custkey % 3 = 0 THEN 'bullet_marker=' || topics || ', course_code_cohort_prefix=1, objectives_header_synonym=1, reference_header_synonym=1, textbook_header_synonym=1, unit_header_synonym=' || units ELSE '' END AS changes FROM c
""")
def rule_hit_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = Y.standardize(_texts(spark, folder))
    told = F.transform(F.array_sort(F.map_entries("changes")), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return rows.select("source_file", F.array_join(told, ", ").alias("changes"))


@query("""
SELECT doc_id, 'TEXT BOOKS:' || chr(10) || 'REFERENCE BOOKS:' || chr(10) || 'UNIT IV x' || chr(10) || 'OBJECTIVES:' || chr(10) || ' – ' || 'one BOOKS ' || doc_id || ' a b' || chr(10) || 'c ME1234' AS text FROM documents
""")
def standardize_rules(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("Recommended text books:\nFurther Reading\nBlock IV x\n course aims :\n\t▪ one Book(s) "), "doc_id", F.lit(" a b\x0cc PTME1234"))
    return Y.standardize(table(spark, folder, "documents").select("doc_id", text.alias("text"))).select("doc_id", "text")


@query("""
SELECT doc_id, 'S- Strong; M- Medium; L- Low' || chr(10) || 'SYLLABUS' || chr(10) || 'UNIT 1 WATER ' || doc_id || chr(10) || 'some text' || chr(10) || 'UNIT 2 FUELS (GAS)' || chr(10) || 'more' || chr(10) || 'TEXT BOOKS' || chr(10) || 'NOT THIS' AS text, 2 AS hits FROM documents
""")
def bare_unit_numbering(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("S- Strong; M- Medium; L- Low\nSYLLABUS\nWATER "), "doc_id", F.lit("\nsome text\n FUELS (GAS) \nmore\nTEXT BOOKS\nNOT THIS"))
    rows = Y.standardize(table(spark, folder, "documents").select("doc_id", text.alias("text")))
    return rows.select("doc_id", "text", F.col("changes")["bare_syllabus_unit_numbering"].alias("hits"))


@query("SELECT s_suppkey, 'Cayley-Hamilton theorem ' || s_suppkey || '|Gram-Schmidt method|Applications|Laplace law|Fourier|plain' AS topics FROM supplier")
def eponym_merge(spark: SparkSession, folder: str) -> DataFrame:
    topics = F.array(F.lit("Cayley"), F.concat(F.lit("Hamilton theorem "), "s_suppkey"), F.lit("Gram"), F.lit("Schmidt method"), F.lit("Applications"), F.lit("Laplace law"), F.lit("Fourier"), F.lit("plain"))
    return table(spark, folder, "supplier").select("s_suppkey", F.array_join(Y.merge_eponyms(topics), "|").alias("topics"))


@query(f"""
WITH {_SQL_LINES}, c AS (SELECT o_custkey, count(*) AS topics, count(DISTINCT unit) AS units FROM l GROUP BY o_custkey)
SELECT 'c/' || o_custkey || '.pdf' AS path, 'ok' AS status, CAST(1 AS BIGINT) AS n_subjects, CAST(0 AS BIGINT) AS n_no_units, CAST(0 AS BIGINT) AS n_no_books, '' AS detail FROM c
UNION ALL SELECT 'd/' || s_suppkey || '.pdf', CASE WHEN s_suppkey % 2 = 0 THEN 'zero_subjects' ELSE 'error' END, 0, 0, 0, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'no text' END FROM supplier
""")
def qa_status(spark: SparkSession, folder: str) -> DataFrame:
    more = table(spark, folder, "supplier").select(F.concat(F.lit("d/"), "s_suppkey", F.lit(".pdf")).alias("source_file"), F.when(F.col("s_suppkey") % 2 == 0, "nothing here").alias("text"))
    return Y.qa(_texts(spark, folder).select("source_file", "text").unionByName(more)).drop("changes")


@query(f"""
WITH {_SQL_LINES}, c AS (SELECT o_custkey, count(*) AS topics, count(DISTINCT unit) AS units FROM l GROUP BY o_custkey)
SELECT 'c/' || o_custkey || '.pdf' AS source_file, 'ME' || (o_custkey % 9000 + 1000) AS code, units AS n_units, topics AS n_topics, CAST(2 AS BIGINT) AS n_textbooks, CAST(1 AS BIGINT) AS n_references, '' AS flags FROM c
""")
def subject_qa(spark: SparkSession, folder: str) -> DataFrame:
    return Y.subject_qa(_texts(spark, folder).select("source_file", "text"))

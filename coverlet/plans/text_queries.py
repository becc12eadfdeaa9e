"""Queries of the text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.scoring import metadata_score
from ..operators.metadata import extract_metadata
from ..sources.tables import table
from .registry import query

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in P.STOPWORDS)
_NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_NORMAL}, ' '), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x))"
_STEM = (
    "CASE WHEN ends_with(x, 'ies') AND length(x) >= 4 THEN x[:-4] || 'y' WHEN ends_with(x, 'ing') AND length(x) >= 6 THEN x[:-4] "
    "WHEN ends_with(x, 'ed') AND length(x) >= 5 THEN x[:-3] WHEN ends_with(x, 'es') AND length(x) >= 4 THEN x[:-3] "
    "WHEN ends_with(x, 's') AND length(x) >= 3 THEN x[:-2] ELSE x END"
)


def sql_tokens(column: str) -> str:
    return _TOKENS.format(column)


def sql_stems(column: str) -> str:
    """The distinct stems of a text's tokens."""
    return f"list_distinct(list_transform({sql_tokens(column)}, lambda x: {_STEM}))"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query("""
WITH t AS (SELECT doc_id, 'e' || chr(11) || 'ect ' || text || ' ' || chr(12) || 'sh ' || chr(13) || ' ' || chr(14) || chr(15) || 'e ﬁn ﬂy ﬀ ﬃ ﬄ ﬅ ﬆ' AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\x0b([a-z])', 'ff\\1', 'g'), '\\x0c([a-z])', 'fi\\1', 'g'), '\\x0d([a-z])', 'fl\\1', 'g'), '\\x0e([a-z])', 'ffi\\1', 'g'), '\\x0f([a-z])', 'ffl\\1', 'g') AS x FROM t)
SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(x, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'ft'), 'ﬆ', 'st') AS fixed FROM a
""")
def ligature_fix(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("e\x0bect "), "text", F.lit(" \x0csh \x0d \x0e\x0fe ﬁn ﬂy ﬀ ﬃ ﬄ ﬅ ﬆ"))
    return _docs(spark, folder).select("doc_id", T.fix_ligatures(text).alias("fixed"))


_SQL_CLEAN = """
WITH t AS (SELECT doc_id, '  (cid:7)hy-' || chr(10) || 'phen' || chr(9) || chr(9) || 'gap' || chr(13) || chr(13) || text || chr(10) || chr(10) || '(cid:12) end  ' AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\\(cid:[0-9]+\\)', ' ', 'g'), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g') AS x FROM t),
m AS (SELECT doc_id, {mashed} AS x FROM a)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(x, chr(13), chr(10)), '[ \\t]{2,}', ' ', 'g'), '\\n{2,}', chr(10), 'g'), '^[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') AS cleaned FROM m
"""
_MASHED = "regexp_replace({0}, '([a-zA-Z])([0-9])', '\\1 \\2', 'g')", "regexp_replace({0}, '([0-9])([a-zA-Z])', '\\1 \\2', 'g')", "regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')"


def _noisy() -> F.Column:
    return F.concat(F.lit("  (cid:7)hy-\nphen\t\tgap\r\r"), "text", F.lit("\n\n(cid:12) end\u2003 \u00a0"))


@query(_SQL_CLEAN.replace("{mashed}", "x"))
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.clean_text(_noisy()).alias("cleaned"))


@query(_SQL_CLEAN.replace("{mashed}", _MASHED[0].format(_MASHED[1].format(_MASHED[2].format("x")))))
def split_mashed(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.clean_text(_noisy(), mashed=True).alias("cleaned"))


@query("SELECT doc_id, text || 'tab' || chr(9) || 'end' AS safe FROM documents")
def sanitize_xml(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("text", F.lit("\x01\x0b\x1f\x7f￾ta\x08b\tend"))
    return _docs(spark, folder).select("doc_id", T.sanitize_xml(text).alias("safe"))


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS normal, CAST(len(list_filter(string_split({_NORMAL.format('text')}, ' '), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def normalize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.normalize(F.col("text")).alias("normal"), F.size(T.tokenize(F.col("text"), False)).alias("n"))


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def stopword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort({sql_stems('text')}), ' ') AS stems FROM documents")
def stem_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.array_join(F.array_sort(T.stem_set(F.col("text"))), " ").alias("stems"))


_SQL_ROMAN = "['', 'M', 'MM', 'MMM'][{0} // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][{0} // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][{0} // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{0} % 10 + 1]"


@query(f"SELECT p_partkey, {_SQL_ROMAN.format('(p_partkey % 3999 + 1)')} AS roman, CAST(p_partkey % 3999 + 1 AS INTEGER) AS back, true AS valid, false AS odd FROM part")
def roman_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    number = (F.col("p_partkey") % 3999 + 1).cast("int")
    rows = table(spark, folder, "part").select("p_partkey", T.int_to_roman(number).alias("roman"))
    return rows.select("p_partkey", "roman", T.roman_to_int(F.col("roman")).alias("back"), T.is_roman(F.col("roman")).alias("valid"), T.is_roman(F.concat("roman", F.lit("IIX"))).alias("odd"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS plain, CAST(l_linenumber AS INTEGER) AS roman, CAST(NULL AS INTEGER) AS wrong FROM lineitem")
def unit_number(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber").cast("int")
    plain, roman, wrong = F.concat(F.lit("unit - "), n), F.concat(F.lit("UNIT: "), T.int_to_roman(n)), F.concat(F.lit("part "), n)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", T.unit_number(plain).alias("plain"), T.unit_number(roman).alias("roman"), T.unit_number(wrong).alias("wrong"))


@query("SELECT p_partkey, p_name AS title, 'Maker ' || p_size || ', ' || replace(p_brand, '#', ' ') AS authors, '' AS none FROM part")
def filename_metadata(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/lib.v2/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_Maker "), F.col("p_size"), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("_.PDF"))
    alone = F.concat(F.lit("/lib/"), "p_type", F.lit(".pdf"))
    return table(spark, folder, "part").select("p_partkey", T.file_title(path).alias("title"), T.file_authors(path).alias("authors"), T.file_authors(alone).alias("none"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS doc_key, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Book ' || p_partkey END AS title, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'A' || p_size END AS authors,
 CASE WHEN p_size % 4 = 0 THEN p_size || 'th edition' ELSE '' END AS edition, CAST(greatest(1950 + p_size, 1990) AS VARCHAR) AS year, 'Reference' AS book_type,
 (3 + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE AS metadata FROM part
""")
def metadata_extract(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("doc_key", F.col("p_partkey").cast("string"))
    docs = part.select("doc_key", F.concat(F.lit("b/Book "), "doc_key", F.lit("_A"), "p_size", F.lit(".pdf")).alias("path"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("Untitled").alias("info_title"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("info_author"))
    text = F.array(F.concat(F.lit("(c) "), F.col("p_size") + 1950, F.lit(" 12019 x1999")), F.concat(F.when(F.col("p_size") % 4 == 0, F.concat("p_size", F.lit("th edition, "))).otherwise(""), F.lit("1990")))
    pages = part.select("doc_key", F.posexplode(text).alias("page_no", "text"))
    rows = extract_metadata(docs, pages)
    return rows.select("doc_key", "title", "authors", "edition", "year", "book_type", metadata_score(*(F.col(c) for c in ("title", "authors", "edition", "year"))).alias("metadata"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN '. ' || l_linestatus ELSE '' END || '. ' AS both, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus || '. ' ELSE '' END AS section FROM lineitem")
def title_prefix(spark: SparkSession, folder: str) -> DataFrame:
    section = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise("")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", T.title_prefix(F.col("l_returnflag"), section).alias("both"), T.title_prefix(F.lit(""), section).alias("section"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a b c d' WHEN s_suppkey % 3 = 0 THEN 'a b c' ELSE 'a b c (Several-Variables O''Neil ' || s_suppkey || 'Th Étude)' END AS query,
 'Supplier_' || s_suppkey || '_.x' AS cached FROM supplier
""")
def semantic_query(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    topic = F.when(key % 2 == 0, "a b c d").otherwise("a b c")
    unit = F.when(key % 3 == 0, "unit 4").otherwise(F.concat(F.lit(" SEVERAL-variables o'neil "), key, F.lit("TH étude ")))
    return table(spark, folder, "supplier").select("s_suppkey", T.semantic_query(topic, unit).alias("query"), T.cache_name(F.concat(F.lit("Supplier#"), key, F.lit("/.x"))).alias("cached"))


@query("""
SELECT l_orderkey, l_linenumber, label, title, CAST(level AS INTEGER) AS level, nullif(label, '') AS again FROM (SELECT l_orderkey, l_linenumber,
 CASE l_linenumber % 4 WHEN 0 THEN l_linenumber || '.' || l_suppkey WHEN 1 THEN 'chapter ' || l_linenumber ELSE '' END AS label,
 CASE l_linenumber % 4 WHEN 0 THEN l_shipmode_x WHEN 1 THEN 'chapter ' || l_linenumber WHEN 2 THEN 'FLAG ' || l_returnflag ELSE 'Problems' END AS title,
 CASE l_linenumber % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS level
 FROM (SELECT *, 'part ' || l_partkey AS l_shipmode_x FROM lineitem))
""")
def split_labels(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber")
    line = (
        F.when(n % 4 == 0, F.concat(n, F.lit("."), "l_suppkey", F.lit(") - part "), "l_partkey", F.lit(" .")))
        .when(n % 4 == 1, F.concat(F.lit("chapter  "), n, F.lit(".")))
        .when(n % 4 == 2, F.concat(F.lit("FLAG "), "l_returnflag"))
        .otherwise("Problems")
    )
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", T.split_label(line).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "s.label", "s.title", "s.level", F.nullif("s.label", F.lit("")).alias("again"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS chapter, CAST(l_linenumber AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS neither FROM lineitem")
def chapter_numbers(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", T.chapter_number(F.concat(F.lit("Chapter "), n)).alias("chapter"), T.section_chapter_number(F.concat(n, F.lit(".12.3"))).alias("section"), T.section_chapter_number(n.cast("string")).alias("neither"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN p >= 90 THEN 'Excellent' WHEN p >= 75 THEN 'Good' WHEN p >= 70 THEN 'Moderate' WHEN p >= 55 THEN 'Tentative' ELSE 'Weak' END AS grade,
 round_even(l_linenumber / 8.0 * 100, 0)::INTEGER || '%' AS rate, '0%' AS nothing FROM (SELECT *, l_quantity * 2 AS p FROM lineitem)
""")
def coverage_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", T.coverage_label(F.col("l_quantity") * 2).alias("grade"), T.rate(F.col("l_linenumber"), F.lit(8)).alias("rate"), T.rate(F.lit(0), F.lit(0)).alias("nothing"))

"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def lit_array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


# Fixed value: what counts as white space, inside a class of a regular expression with Unicode's classes (UNICODE first).
SPACE, UNICODE = "\\s\\x1c-\\x1f", "(?U)"


def strip(c: Column, chars: str = SPACE) -> Column:
    """Without the characters of a regex class at both ends."""
    return F.regexp_replace(c, f"{UNICODE}^[{chars}]+|[{chars}]+$", "")


def words(c: Column) -> Column:
    """White-space-separated words; of blank text none."""
    return F.filter(F.split(c, f"{UNICODE}[{SPACE}]+"), lambda w: w != "")


def fix_ligatures(c: Column) -> Column:
    """Ligature codes to letters. Control codes are tagged first, so that no letter made here enables a neighbour."""
    tag = ""
    c = F.regexp_replace(c, "([\\x0b-\\x0f])(?=[a-z])", f"{tag}$1")
    c = reduce(lambda c, r: F.replace(c, F.lit(tag + r[0]), F.lit(r[1])), P.CONTROL_LIGATURES, c)
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), P.LIGATURES, c)


def split_mashed(c: Column) -> Column:
    """A space between a small letter and a capital, and between letters and digits."""
    c = F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")
    return F.regexp_replace(c, "(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])", " ")


def clean_text(c: Column, mashed: bool = False) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\\(cid:[0-9]+\\)", " ")
    c = F.regexp_replace(c, "([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])", "$1$2")
    c = split_mashed(c) if mashed else c
    c = F.replace(c, F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{2,}", "\n")
    return strip(c)


def normalize(c: Column) -> Column:
    """Lower case, other than letters, numbers and underscores to single spaces."""
    c = F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_\\s]", " ")
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def tokenize(c: Column, drop_stopwords: bool = True) -> Column:
    tokens = F.filter(F.split(normalize(c), " "), lambda w: w != "")
    if not drop_stopwords:
        return tokens
    stop = lit_array(P.STOPWORDS)
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def stem(w: Column) -> Column:
    """The first rule whose suffix fits and leaves enough letters."""
    out = None
    for suffix, put, least in P.STEM_RULES:
        fits = F.endswith(w, F.lit(suffix)) & (F.length(w) - len(suffix) >= least)
        value = F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(put))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(w)


def stem_set(c: Column) -> Column:
    """The distinct stems of the tokens; each distinct token is looked at once, stop words are left out as a set."""
    tokens = F.array_except(F.split(normalize(c), " "), lit_array(("", *P.STOPWORDS)))
    return F.array_distinct(F.transform(F.filter(tokens, lambda w: F.length(w) > 1), stem))


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter, small letters after letters."""
    parts = F.regexp_extract_all(c, F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def is_roman(c: Column) -> Column:
    c = F.upper(F.trim(c))
    return (c != "") & c.rlike(P.JAVA_ROMAN)


def roman_to_int(c: Column) -> Column:
    """The value of a valid numeral, else null."""
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).when(x == "D", 500).otherwise(1000)
    digits = F.reverse(F.split(F.upper(F.trim(c)), ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda s, x: F.struct((s.total + F.when(value(x) < s.last, -value(x)).otherwise(value(x))).alias("total"), F.greatest(s.last, value(x)).alias("last"))
    return F.when(is_roman(c), F.aggregate(digits, start, step, lambda s: s.total))


def int_to_roman(n: Column) -> Column:
    """Numerals of 1 to 3999; an error outside."""
    tables = (("", "M", "MM", "MMM"), *(("", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c) for a, b, c in (("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X"))))
    digit = lambda size: F.pmod(F.floor(n / size), F.lit(10)).cast("int")
    out = F.concat(*(F.get(lit_array(t), digit(size)) for t, size in zip(tables, (1000, 100, 10, 1), strict=True)))
    return F.when((n > 0) & (n < 4000), out).otherwise(F.raise_error(F.lit("roman numerals are for 1 to 3999")))


def unit_number(label: Column) -> Column:
    token = F.regexp_extract(label, P.JAVA_UNIT_NUMBER, 1)
    return F.when(token.rlike("^[0-9]+$"), F.try_to_number(token, F.lit("9999999999")).cast("int")).when(token != "", roman_to_int(token))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)\\.[^.]*$", "")


def file_title(path: Column) -> Column:
    stem_ = file_stem(path)
    title = F.when(F.contains(stem_, F.lit("_")), F.substring_index(stem_, "_", 1)).otherwise(stem_)
    return strip(F.regexp_replace(title, "[-_]+", " "))


def file_authors(path: Column) -> Column:
    stem_ = file_stem(path)
    rest = F.when(F.contains(stem_, F.lit("_")), F.substring(stem_, F.instr(stem_, "_") + 1, F.length(stem_))).otherwise(F.lit(""))
    return strip(F.replace(rest, F.lit("_"), F.lit(", ")), " ,")


def title_prefix(chapter: Column, section: Column) -> Column:
    """The titles that are not empty, each with a full stop and a space."""
    return F.array_join(F.transform(F.filter(F.array(chapter, section), lambda t: t != ""), lambda t: F.concat(t, F.lit(". "))), "")


def semantic_query(topic: Column, unit_title: Column) -> Column:
    """Topics of fewer than four words get their unit's title, unless it is only a number."""
    title = strip(unit_title)
    helps = (title != "") & ~F.startswith(F.upper(title), F.lit("UNIT"))
    return F.when((F.size(words(topic)) < 4) & helps, F.concat(topic, F.lit(" ("), title_case(title), F.lit(")"))).otherwise(topic)


def cache_name(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9_.-]", "_")


def split_label(c: Column) -> Column:
    """(label, title, level) of a contents entry: numbered, Chapter/Unit/Part, or neither."""
    dotted, chapter = c.rlike(P.JAVA_NUMERIC_LABEL), c.rlike(P.JAVA_CHAPTER_LABEL)
    part = lambda k: F.regexp_extract(c, P.JAVA_CHAPTER_LABEL, k)
    label = F.when(dotted, F.regexp_extract(c, P.JAVA_NUMERIC_LABEL, 1)).when(chapter, F.concat(part(1), F.lit(" "), part(2))).otherwise("")
    rest = F.when(dotted, F.regexp_extract(c, P.JAVA_NUMERIC_LABEL, 2)).when(chapter, part(3))
    rest = strip(rest, " .-")
    title = F.when(label == "", c).when(rest == "", label).otherwise(rest)
    caps = (F.upper(c) == c) & (F.lower(c) != c) & (F.size(words(c)) >= 2)
    dots = F.length(label) - F.length(F.replace(label, F.lit("."), F.lit("")))
    level = F.when(dotted, dots + 1).when(chapter | caps, 1).otherwise(2)
    return F.struct(label.alias("label"), title.alias("title"), level.cast("int").alias("level"))


def chapter_number(label: Column) -> Column:
    """The number that ends a chapter's label, as text; null without one."""
    return F.nullif(F.regexp_extract(F.trim(label), "(\\d+)\\s*$", 1), F.lit(""))


def section_chapter_number(label: Column) -> Column:
    """The chapter's number in a section label such as 3.4; null in others."""
    return F.nullif(F.regexp_extract(label, "^(\\d+)\\.\\d", 1), F.lit(""))


def coverage_label(percent: Column) -> Column:
    grades = ((90, "Excellent"), (75, "Good"), (70, "Moderate"), (55, "Tentative"))
    out = F.when(percent >= grades[0][0], grades[0][1])
    for least, name in grades[1:]:
        out = out.when(percent >= least, name)
    return out.otherwise("Weak")


def rate(part: Column, whole: Column) -> Column:
    """A whole percentage, halves to even; 0% of nothing."""
    return F.when(whole > 0, F.concat(F.bround(part / whole * 100, 0).cast("int").cast("string"), F.lit("%"))).otherwise("0%")


def sanitize_xml(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFE\\uFFFF]", "")

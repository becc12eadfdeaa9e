"""Citations: their scope notes, and which book of a catalog each one means."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from ..functions import patterns as P
from ..functions.fuzzy import partial_ratio, token_set_ratio, weighted_ratio

_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
_VALID_ROMAN = P.re.compile(P.JAVA_ROMAN)


def _unit_value(token: str) -> int | None:
    if token.isdigit():
        return int(token)
    if not _VALID_ROMAN.match(token):
        return None
    values = [_ROMAN[c] for c in token]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def scope_units(note: str) -> set[int]:
    """Unit numbers in a note; a range word between two of them means all from one to the other."""
    tokens = [(m, v) for m in P.UNIT_TOKEN.finditer(note) if (v := _unit_value(m[0])) is not None]
    out = {v for _, v in tokens}
    for (m, low), (n, high) in zip(tokens, tokens[1:], strict=False):
        if low < high <= low + P.LONGEST_RANGE and P.UNIT_RANGE_GAP.match(note[m.end() : n.start()]):
            out.update(range(low, high + 1))
    return out


def scope_sections(note: str) -> set[str]:
    """Section labels in a note; a range within one chapter means all its sections, another range its ends."""
    note = P.PARENTHESES.sub("", note).rstrip(" .")
    out: set[str] = set()
    for item in P.re.sub(r"\s+and\s+", ",", note, flags=P.re.I).split(","):
        item = item.strip(" .")
        if span := P.SECTION_RANGE.match(item):
            low, high = span[1].split("."), span[2].split(".")
            out |= {span[1], span[2]}
            if len(low) == len(high) == 2 and low[0] == high[0] and 0 <= int(high[1]) - int(low[1]) <= P.LONGEST_RANGE:
                out -= {span[1], span[2]}
                out |= {f"{low[0]}.{k}" for k in range(int(low[1]), int(high[1]) + 1)}
        elif P.SECTION_LABEL.fullmatch(item):
            out.add(item)
    return out


def citation_scope(line: str | None) -> tuple[list[int], list[str]]:
    """Units and sections that a citation's last bracket restricts it to, sorted; empty: no restriction."""
    notes = P.BRACKET.findall(line or "")
    if not notes:
        return [], []
    note = notes[-1]
    if both := P.UNITS_AND_SECTIONS.search(note):
        units, sections = both[1], both[2]
    else:
        alone = (P.UNITS_ONLY.search(note), P.SECTIONS_ONLY.search(note))
        units, sections = (m[1] if m else "" for m in alone)
    return sorted(scope_units(units)), sorted(scope_sections(sections))


#: Built here, as a worker that imports this module cannot parse type names.
_SCOPE = T.StructType([T.StructField("units", T.ArrayType(T.IntegerType())), T.StructField("sections", T.ArrayType(T.StringType()))])


@F.pandas_udf(_SCOPE)
def scope_column(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([citation_scope(x) for x in lines], columns=["units", "sections"])


def _said(line: str) -> tuple[str, str]:
    """The title that a lower-case line says, empty without one, and what may name its authors."""
    quoted = P.QUOTED_TITLE.search(line)
    said = quoted or P.TITLE_BY.match(line)
    return said[1].strip() if said else "", line[: quoted.start()] if quoted else line


def match_score(line: str, title: str, authors: str, filename: str, config: EngineConfig = DEFAULT) -> float:
    """How well a citation fits a book, 0 to 100.

    With a title in quotation marks or before "By": title and author likeness, and 0 without likeness to the authors
    in what stands before the title. Otherwise the line against title, authors and file name together.
    """
    line, title, authors, filename = (x.lower() for x in (line, title, authors, filename))
    said_title, region = _said(line)
    if not (said_title and title):
        return weighted_ratio(line, f"{title} {authors} {filename}")
    by = partial_ratio(region, authors) if authors else 0.0
    if by < config.author_gate:
        return 0.0
    return config.title_weight * token_set_ratio(said_title, title) + config.author_weight * by


class Shelf:
    """Books (seq, key, title, authors, file name) in order, searched for the first one with the best match_score.

    Likeness to authors is computed once for each of their names and text before a title. Names are tried in falling
    order of it until not even an equal title could reach the best score so far, so no book that could win is left out.
    """

    def __init__(self, books: list, config: EngineConfig = DEFAULT):
        self.config, self.books, self.region, self.ranked = config, books, None, []
        self.titled: dict[str, dict[str, int]] = {}
        self.texts: dict[tuple, int] = {}
        self.untitled: dict[tuple, int] = {}
        for at, (_, _, *texts) in enumerate(books):
            title, authors, filename = text = tuple((x or "").lower() for x in texts)
            self.texts.setdefault(text, at)
            if title:
                self.titled.setdefault(authors, {}).setdefault(title, at)
            else:
                self.untitled.setdefault(text, at)
        self.likeness = lru_cache(1 << 16)(token_set_ratio)

    def _authors(self, region: str) -> list[tuple[float, str]]:
        if region != self.region:
            found = ((partial_ratio(region, a) if a else 0.0, a) for a in self.titled)
            self.region, self.ranked = region, sorted((x for x in found if x[0] >= self.config.author_gate), reverse=True)
        return self.ranked

    def best(self, line: str) -> tuple[float, object, object]:
        """(score, key, seq), (0, None, None) where no book scores."""
        line = line.lower()
        title, region = _said(line)
        top, place = 0.0, len(self.books)
        for text, at in (self.untitled if title else self.texts).items():
            score = weighted_ratio(line, " ".join(text))
            if score > top or score == top > 0 and at < place:
                top, place = score, at
        for by, authors in self._authors(region) if title else ():
            if self.config.title_weight * 100.0 + self.config.author_weight * by < top:
                break
            for known, at in self.titled[authors].items():
                score = self.config.title_weight * self.likeness(title, known) + self.config.author_weight * by
                if score > top or score == top > 0 and at < place:
                    top, place = score, at
        return (top, self.books[place][1], self.books[place][0]) if top else (0.0, None, None)

    def find(self, lines) -> tuple[list, list, list]:
        """Keys, scores and seqs of the lines; lines with the same text before the title are looked up together."""
        found = {x: self.best(x) for x in sorted({x or "" for x in lines}, key=lambda x: _said(x.lower())[1])}
        out = [found[x or ""] for x in lines]
        return [x[1] for x in out], [x[0] for x in out], [x[2] for x in out]


def resolve(citations: DataFrame, catalog: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The citations (raw_line, ...) with book_key and match_score.

    catalog: (book_seq, book_key, title, authors, filename). The best score wins, the first book of equals; below the
    threshold the key is null and the score stays. A catalog of at most config.catalog_rows rows is held by each task;
    a larger one is compared in blocks of that size, and only each block's best leaves it. No pairs are made.
    """
    names = citations.columns
    books = catalog.select("book_seq", "book_key", "title", "authors", "filename")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in citations.schema)
    n = books.count()
    # A row costs a search of the whole catalog, so rows are spread over all tasks first; texts before a title stay together.
    region = F.substring_index(F.lower(F.coalesce("raw_line", F.lit(""))), '"', 1)
    citations = citations.repartition(int(citations.sparkSession.conf.get("spark.sql.shuffle.partitions")), region).sortWithinPartitions(region)

    if n <= config.catalog_rows:
        held = [tuple(r) for r in books.orderBy("book_seq").collect()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shelf = Shelf(held, config)
            for batch in batches:
                keys, scores, _ = shelf.find(batch["raw_line"])
                yield batch.assign(book_key=keys, match_score=scores)

        found = citations.mapInPandas(run, f"{kinds}, book_key string, match_score double")
    else:
        blocks = -(-n // config.catalog_rows)
        books = books.withColumn("_b", F.pmod("book_seq", F.lit(blocks)).cast("int"))
        line = F.coalesce("raw_line", F.lit(""))
        each = citations.select(line.alias("_line")).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def compare(lines: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            known = list(some.sort_values("book_seq").drop(columns="_b").itertuples(index=False, name=None))
            keys, scores, seqs = Shelf(known, config).find(lines["_line"])
            return lines[["_line"]].assign(book_key=keys, match_score=scores, book_seq=[-1 if s is None else s for s in seqs])

        tops = each.groupBy("_b").cogroup(books.groupBy("_b")).applyInPandas(compare, "_line string, book_key string, match_score double, book_seq long")
        top = tops.groupBy("_line").agg(F.max(F.struct("match_score", (-F.col("book_seq")).alias("o"), "book_key")).alias("t"))
        found = citations.join(top, line == F.col("_line")).select(*names, F.col("t.book_key").alias("book_key"), F.col("t.match_score").alias("match_score"))
    return found.withColumn("book_key", F.when(F.col("match_score") >= config.resolve_score, F.col("book_key")))


def cited_keys(resolved: DataFrame, *subject: str) -> DataFrame:
    """(subject, citation_type, book_key, key_seq): each subject's resolved books of each kind, first mentions only."""
    return resolved.where("book_key is not null").groupBy(*subject, "citation_type", "book_key").agg(F.min("cite_seq").alias("key_seq"))


def book_scopes(resolved: DataFrame, *subject: str) -> DataFrame:
    """(subject, book_key, scope): the first restricted scope among a subject's citations of a book, else none."""
    rows = resolved.where("book_key is not null").withColumn("scope", scope_column("raw_line"))
    free = (F.size("scope.units") == 0) & (F.size("scope.sections") == 0)
    first = F.row_number().over(Window.partitionBy(*subject, "book_key").orderBy(free, "cite_seq"))
    return rows.withColumn("_k", first).where("_k = 1").select(*subject, "book_key", "scope")


def cited_only(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """The rows (book_key, ...) of books that some citation resolved to."""
    return rows.join(resolved.where("book_key is not null").select("book_key").distinct(), "book_key", "left_semi")


def unreadable(resolved: DataFrame, catalog: DataFrame, chunks: DataFrame, *subject: str) -> DataFrame:
    """(subject, unreadable): titles of cited books of the catalog without chunks, sorted, joined by commas."""
    keys = resolved.where("book_key is not null").select(*subject, "book_key").distinct()
    empty = keys.join(catalog.select("book_key", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("book_key")).alias("t")), "book_key").join(chunks.select("book_key").distinct(), "book_key", "left_anti")
    return empty.groupBy(*subject).agg(F.array_join(F.array_sort(F.collect_list("t")), ", ").alias("unreadable"))

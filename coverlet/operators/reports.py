"""Reports on recommendations, and where they go."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import rate, sanitize_xml


def counts(status: str = "status"):
    of = lambda name: F.count_if(F.col(status) == name)
    return of("Found").alias("found"), of("Tentative").alias("tentative"), of("Not Found").alias("not_found"), F.count("*").alias("total")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of rows by subject in order of first appearance, the last row's name, and a TOTAL row without a rate.

    rows: (seq, syllabus_name, subject_code, subject_name, status). One pass with grouping sets.
    """
    sets = rows.groupingSets([["syllabus_name", "subject_code"], []], "syllabus_name", "subject_code")
    grouped = sets.agg(*counts(), F.max_by("subject_name", "seq").alias("name"), F.min("seq").alias("first"), F.grouping("subject_code").alias("g"))
    covered = rate(F.col("found") + F.col("tentative"), F.col("total"))
    total = F.col("g") == 1
    out = grouped.select(F.when(total, "TOTAL").otherwise(F.col("syllabus_name")).alias("syllabus"), F.when(~total, F.col("subject_code")).alias("subject_code"), F.when(~total, F.col("name")).alias("subject_name"), "found", "tentative", "not_found", "total", F.when(~total, covered).alias("coverage_rate"), "g", "first")
    return out.orderBy("g", "first").drop("g", "first")


def topic_summary(rows: DataFrame) -> DataFrame:
    """Like summary's subject rows, with topics counted instead of report rows (by each topic's first status)."""
    topics = rows.groupBy("syllabus_name", "subject_code", "module_number", "topic").agg(F.min_by("status", "seq").alias("status"))
    return topics.groupBy("syllabus_name", "subject_code").agg(*counts())


def counters(subjects: DataFrame, topics: DataFrame, resolved: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of the run's counts; what is not Found counts as not found."""
    one = lambda df, *aggs: df.agg(*aggs)
    return (
        one(subjects, F.count("*").alias("subjects"))
        .join(one(topics, F.count("*").alias("topics")))
        .join(one(resolved, F.count("*").alias("citations"), F.count("book_key").alias("resolved")))
        .join(one(rows, F.count_if(F.col("status") == "Found").alias("found"), F.count_if(F.col("status") != "Found").alias("not_found")))
    )


def report(rows: DataFrame) -> DataFrame:
    """The report's columns in order under their headings, characters that XML forbids left out."""
    kinds = dict(rows.dtypes)
    return rows.select(*((sanitize_xml(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(name) for c, name in P.REPORT_COLUMNS))


def write_report(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Two data sets below the path: recommendations and summary."""
    for name, df in (("recommendations", report(rows) if kind == "csv" else rows), ("summary", summary(rows))):
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{path}/{name}")


def write_text(standard: DataFrame, path: str) -> None:
    """The texts (source_file, text) as text files, one folder a source; null texts are empty."""
    named = standard.select(F.element_at(F.split("source_file", "/"), -1).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    named.write.mode("overwrite").partitionBy("source").text(path)


#: A workbook's two cell styles: plain, and bold white on dark in the middle for headings.
STYLES = """<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF203040"/></patternFill></fill></fills>
<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="2"><xf xfId="0"/><xf xfId="0" fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf></cellXfs>
</styleSheet>"""


def column_letters(n: int) -> str:
    """The name of a sheet's n-th column, from 1: A to Z, AA, ..."""
    return (column_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def write_workbook(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """An .xlsx file of both sheets, with styled and frozen headings, filters and widths by content, for reports of at most `most` rows; larger ones go to write_report."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows are too many for a workbook")
    sheets = {"Recommendations": report(rows.orderBy("seq")), "Summary": summary(rows)}
    rels, book = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in (1, 2))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rels}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2)) + f'<Relationship Id="r3" Type="{rels}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{book}" xmlns:r="{rels}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for k, df in enumerate(sheets.values(), 1):
            lines = [df.columns, *df.collect()]
            body = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in lines).replace("<c ", '<c s="1" ', len(df.columns))
            wide = [min(40, 2 + max(len(str(v)) for v in column if v is not None)) for column in zip(*lines, strict=True)]
            cols = "".join(f'<col min="{n}" max="{n}" width="{w}" customWidth="1"/>' for n, w in enumerate(wide, 1))
            view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0"?><worksheet xmlns="{book}">{view}<cols>{cols}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{column_letters(len(wide))}{len(lines)}"/></worksheet>')


def chapter_listing(chapters: DataFrame, sections: int = 5) -> DataFrame:
    """(doc_key, chapter_no, line) of a book's tree: its chapters, the first sections of each, and how many more."""
    head = F.concat_ws(" ", "label", "title")
    return chapters.select("doc_key", "chapter_no", head.alias("chapter"), F.transform(F.slice("sections", 1, sections), lambda s: F.concat_ws(" ", s.label, s.title)).alias("first_sections"), F.greatest(F.size("sections") - sections, F.lit(0)).alias("more"))

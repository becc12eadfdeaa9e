"""python -m coverlet --books-dir DIR --syllabi-dir DIR --output DIR [--subjects CODE,...] [--books NAME,...] [--workbook FILE] [--cache DIR] [--qa [--dump DIR]] [--text] [--quiet]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import EngineConfig
from .log import LOG, verbose
from .operators.reports import write_report, write_text, write_workbook
from .operators.syllabus import qa, standardize
from .plans.coverage import read_syllabi, run_folders
from .sources.tables import find_files, pdf_pages, text_pages


def main(args: list[str] | None = None) -> None:
    default = EngineConfig()
    parser = argparse.ArgumentParser(prog="coverlet", description="Recommend passages of books for the topics of syllabi.")
    parser.add_argument("--books-dir", default=default.books_dir)
    parser.add_argument("--syllabi-dir", default=default.syllabi_dir)
    parser.add_argument("--output", default=default.output)
    parser.add_argument("--subjects", type=lambda x: x.split(","), help="only these course codes")
    parser.add_argument("--books", type=lambda x: x.split(","), help="only these books")
    parser.add_argument("--workbook", help="also write both sheets to this .xlsx file of the driver")
    parser.add_argument("--cache", default=default.cache_dir, help="keep passages' vectors in this folder between runs")
    parser.add_argument("--dump", help="with --qa: write the standardised texts below this folder")
    parser.add_argument("--quiet", action="store_true", help="only tell errors")
    parser.add_argument("--qa", action="store_true", help="report on the syllabi instead")
    parser.add_argument("--only-problems", action="store_true", help="with --qa: leave out syllabi that are ok")
    parser.add_argument("--text", action="store_true", help="files are plain text (.txt) with form feeds between pages")
    given = parser.parse_args(args)
    verbose(not given.quiet)
    spark = SparkSession.builder.appName("coverlet").getOrCreate()
    reader, extension = (text_pages, ".txt") if given.text else (pdf_pages, ".pdf")
    if given.qa:
        syllabi = read_syllabi(find_files(spark, given.syllabi_dir, extension), reader)
        if given.dump:
            write_text(standardize(syllabi), given.dump)
        rows = qa(syllabi)
        rows = rows.where("status <> 'ok'") if given.only_problems else rows
        rows.select("path", "status", "n_subjects", "n_no_units", "n_no_books", "changes", "detail").write.mode("overwrite").option("header", True).csv(given.output)
        return
    config = EngineConfig(books_dir=given.books_dir, syllabi_dir=given.syllabi_dir, output=given.output, cache_dir=given.cache)
    run = run_folders(spark, config, extension, reader if given.text else None, codes=given.subjects, books=given.books)
    write_report(run.recommendations, given.output)
    if given.workbook:
        write_workbook(run.recommendations, given.workbook)
    LOG.info("report written to %s", given.output)
    run.summary().show(50, truncate=False)


if __name__ == "__main__":
    main()

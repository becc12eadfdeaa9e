"""Tables of a data folder, and documents read from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def find_files(spark: SparkSession, folder: str, extension: str = ".pdf", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, content) of the files with the extension in any case, below or only in the folder.

    Only what is selected is read: without `content` no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(F.endswith(F.lower("path"), F.lit(extension.lower())))


def doc_keys(files: DataFrame) -> DataFrame:
    """The files with doc_key (the name without its last extension) and doc_seq (by path)."""
    ranked = files.select("path").orderBy("path").select("path", F.monotonically_increasing_id().alias("doc_seq"))
    return files.join(ranked, "path").withColumn("doc_key", file_stem(F.col("path")))


#: Takes a file's bytes, returns its pages' texts.
Reader = Callable[[bytes], list[str]]


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text file, which form feeds part."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_pages(content: bytes) -> list[str]:
    """Pages of a PDF file, by an optional library; a page that cannot be read is empty."""
    import io

    import pypdf

    out = []
    for page in pypdf.PdfReader(io.BytesIO(content), strict=False).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:
            out.append("")
    return out


def read_pages(files: DataFrame, reader: Reader = text_pages) -> DataFrame:
    """(doc_key, page_no, text, error) of files (doc_key, content). A file that cannot be read has no pages but one row
    with a null page_no and the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(key, k, text, None) for k, text in enumerate(reader(content))]
                except Exception as e:
                    rows.append((key, None, None, f"{type(e).__name__}: {e}"[:500]))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_key", "page_no", "text", "error"])

    return files.select("doc_key", "content").mapInArrow(run, "doc_key string, page_no int, text string, error string")


#: Takes a file's bytes, returns its title and author.
InfoReader = Callable[[bytes], tuple[str | None, str | None]]
#: Takes a file's bytes and a number of pages, gives the characters (top, x0, size, text) of each page up to it.
CharReader = Callable[[bytes, int], Iterator[list[tuple[float, float, float, str]]]]


def pdf_info(content: bytes) -> tuple[str | None, str | None]:
    """Title and author by a PDF file's information entries."""
    import io

    import pypdf

    found = pypdf.PdfReader(io.BytesIO(content), strict=False).metadata or {}
    return tuple(None if found.get(k) is None else str(found[k]) for k in ("/Title", "/Author"))


def pdf_chars(content: bytes, pages: int) -> Iterator[list[tuple[float, float, float, str]]]:
    """Characters of a PDF file's first pages, by an optional library; a page that cannot be read has none."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages[:pages]:
            try:
                yield [(float(c["top"]), float(c["x0"]), float(c.get("size") or 0), c["text"]) for c in page.chars]
            except Exception:
                yield []
            page.close()


def read_info(files: DataFrame, reader: InfoReader | None) -> DataFrame:
    """(doc_key, path, info_title, info_author) of files (doc_key, path, content); empty where there is none, the
    file cannot be read or there is no reader. Files with null content have none."""
    if reader is None:
        return files.select("doc_key", "path", F.lit("").alias("info_title"), F.lit("").alias("info_author"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for content in batch.column(2):
                try:
                    told.append(reader(content.as_py()))
                except ImportError:
                    raise
                except Exception:
                    told.append((None, None))
            entries = [pa.array([t[k] or "" for t in told], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *entries], ["doc_key", "path", "info_title", "info_author"])

    return files.select("doc_key", "path", "content").mapInArrow(run, "doc_key string, path string, info_title string, info_author string")


def read_chars(files: DataFrame, reader: CharReader, pages: int) -> DataFrame:
    """(doc_key, page_no, char_seq, top, x0, size, text) of the first pages of files (doc_key, content), a page at a time.

    A file that cannot be read, or has null content, gives what was read before the failure.
    """
    names = ("doc_key", "page_no", "char_seq", "top", "x0", "size", "text")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for page, chars in enumerate(reader(content.as_py(), pages)):
                        rows = [(key, page, k, *c) for k, c in enumerate(chars)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))
                except ImportError:
                    raise
                except Exception:
                    continue

    return files.select("doc_key", "content").mapInArrow(run, "doc_key string, page_no int, char_seq int, top double, x0 double, size double, text string")

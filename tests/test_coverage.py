"""The whole run on two small books and a syllabus."""

import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlet.__main__ import main
from coverlet.config import EngineConfig
from coverlet.operators.vectors import HashingEncoder, encode_cached
from coverlet.plans.coverage import book_chapters, calibrate, pick_books, run_folders
from coverlet.sources.tables import read_chars, read_info, text_pages

HEAT = [
    "cover",
    "CONTENTS\n1 Heat Flow ..... 11\n1.1 Conduction of heat in walls ..... 11\n1.2 Convection in moving fluids ..... 13\n2 Radiation ..... 15\n2.1 Black body radiation ..... 15\n",
    *["left blank"] * 8,
    "Heat Flow\nConduction of heat in walls\n" + "conduction of heat through solid walls and plates " * 20,
    "more about conduction walls " * 20,
    "Convection in moving fluids\n" + "convection carries heat with moving fluids and gases " * 20,
    "convection fluids boundary layers " * 20,
    "Radiation\nBlack body radiation\n" + "black body radiation emits energy at all wavelengths " * 20,
]
SYLLABUS = """ME1234 HEAT TRANSFER L T P C
COURSE OBJECTIVES: to learn
UNIT I CONDUCTION 9
Conduction of heat in walls – Convection in moving fluids
UNIT II RADIATION 9
Black body radiation – Poems of spring
TEXT BOOKS:
1. Maria Keller, "Heat Flow Basics", Press, 2019. [For Units I to II - Sections 1.1, 1.2 and 2.1]
REFERENCES:
1. Otto Nobody, "Unknown Matters", Press, 2001.
OUTCOMES: x
XY9999 OTHER L T P C
OBJECTIVES: y
UNIT I ALONE
"""


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("run")
    for name in ("books", "syllabi/sub"):
        (top / name).mkdir(parents=True)
    (top / "books/Heat-Flow-Basics_Maria Keller.txt").write_text("\f".join(HEAT))
    (top / "books/Empty-Book_No One.txt").write_text("")
    (top / "syllabi/sub/mech.txt").write_text(SYLLABUS)
    return top


def test_run(spark, folders):
    # The offline encoder's similarities are lower than a trained model's.
    config = EngineConfig(books_dir=str(folders / "books"), syllabi_dir=str(folders / "syllabi"), similarity_floor=0.0, similarity_ceiling=0.7)
    run = run_folders(spark, config, ".txt", text_pages)
    assert [(r.label, r.page_start, len(r.sections)) for r in run.chapters.orderBy("chapter_no").collect()] == [("1", 10, 2), ("2", 14, 1)]
    rows = {r.topic: r for r in run.recommendations.collect()}
    assert set(rows) == {"Conduction of heat in walls", "Convection in moving fluids", "Black body radiation", "Poems of spring", "ALONE"}
    assert rows["Conduction of heat in walls"].chapter == "1.1 Conduction of heat in walls"
    assert rows["Convection in moving fluids"].chapter == "1.2 Convection in moving fluids"
    assert (rows["Convection in moving fluids"].pdf_page_start, rows["Convection in moving fluids"].page_start) == (13, 13)
    assert rows["Black body radiation"].status == "Found"
    assert rows["Poems of spring"].notes.startswith("Cited books available")
    assert rows["ALONE"].notes.startswith("No cited")
    assert [r.total for r in run.summary().collect()] == [4, 1, 5]
    told = run.counters().first()
    assert (told.subjects, told.topics, told.citations, told.resolved) == (2, 5, 2, 1)
    assert calibrate(run, config=config).first().n == 4
    focused = run_folders(spark, config, ".txt", text_pages, codes=["me1234"], books=["Heat-Flow-Basics_Maria Keller"])
    assert focused.recommendations.select(F.count_distinct("subject_code")).first()[0] == 1
    with pytest.raises(ValueError, match="Nothing"):
        pick_books(spark.createDataFrame([("a", "a.pdf")], "doc_key string, path string"), ["Nothing.pdf", "a.PDF"])


def test_command_line(spark, folders, tmp_path):
    extra = ["--workbook", str(tmp_path / "r.xlsx"), "--cache", str(tmp_path / "cache")]
    main(["--books-dir", str(folders / "books"), "--syllabi-dir", str(folders / "syllabi"), "--output", str(tmp_path / "r"), "--text", *extra])
    assert spark.read.parquet(str(tmp_path / "r/recommendations")).count() == 5
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert b"<cellXfs" in z.read("xl/styles.xml")
    assert len(re.findall("<row>", sheet)) == 6
    assert sheet.count('s="1"') == len(re.findall("<col ", sheet)) == 21
    assert 'autoFilter ref="A1:U6"' in sheet
    kept = spark.read.parquet(str(tmp_path / "cache"))
    assert kept.count() == kept.select("text_hash").distinct().count() > 0
    main(["--syllabi-dir", str(folders / "syllabi"), "--output", str(tmp_path / "qa"), "--text", "--qa", "--quiet", "--dump", str(tmp_path / "dump")])
    assert "UNIT I" in "".join(f.read_text() for f in (tmp_path / "dump").rglob("part-*.txt"))
    row = spark.read.option("header", True).csv(str(tmp_path / "qa")).first()
    assert (row.status, row.n_subjects, row.n_no_books) == ("partial", "2", "1")


def test_font_fallback(spark):
    """Only books without usable contents are read for characters; their large lines become chapters."""

    def sized_chars(content, pages):
        """Lines `size|text`, pages parted by form feeds; a page `bad` fails."""
        for page in content.decode().split("\f")[:pages]:
            if page == "bad":
                raise ValueError("bad page")
            yield [(float(n), float(x), float(line.split("|")[0]), c) for n, line in enumerate(page.splitlines()) for x, c in enumerate(line.split("|")[1])]

    plain = "10|body one\n10|body two\n10|body three"
    files = [("a", b"20|Heat\n" + plain.encode() + b"\f" + plain.encode() + b"\f20|Light\n14|Lenses\n" + plain.encode()), ("b", b"20|Never\n" + plain.encode()), ("c", b"bad"), ("d", None), ("e", b"")]
    table = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in files], "doc_key string, content binary")
    contents = "CONTENTS\n" + "".join(f"{n} Title Number{n} ..... {n}\n" for n in range(1, 6))
    pages = [("a", k, "body") for k in range(4)] + [("b", 0, contents)] + [("b", k, f"Title Number{k}\nwords") for k in range(1, 7)] + [(d, 0, "x") for d in "cde"]
    asked = []

    def chars(needed):
        asked.extend(r.doc_key for r in needed.collect())
        return read_chars(table.join(needed, "doc_key", "left_semi"), sized_chars, 500)

    got = book_chapters(spark.createDataFrame(pages, "doc_key string, page_no int, text string"), chars).collect()
    assert sorted(asked) == ["a", "c", "d", "e"]
    found = sorted((r.title, r.page_start, r.page_end, [s.title for s in r.sections]) for r in got if r.doc_key == "a")
    assert found == [("Heat", 0, 1, []), ("Light", 2, 3, ["Lenses"])]
    assert {r.doc_key for r in got} == {"a", "b"}
    assert "Never" not in {r.title for r in got}
    assert read_chars(table.where("doc_key = 'a'"), sized_chars, 1).agg(F.max("page_no")).first()[0] == 0


def test_info(spark):
    """Unreadable files and missing entries give empty strings."""
    rows = spark.createDataFrame([("a", "p/a", bytearray(b"T;A")), ("b", "p/b", bytearray(b"bad")), ("c", "p/c", None), ("d", "p/d", bytearray(b";A"))], "doc_key string, path string, content binary")
    got = read_info(rows, lambda c: tuple(x or None for x in c.decode().split(";", 1)[:2]) if b";" in c else 1 / 0)
    assert sorted(map(tuple, got.collect())) == [("a", "p/a", "T", "A"), ("b", "p/b", "", ""), ("c", "p/c", "", ""), ("d", "p/d", "", "A")]
    assert {(r.info_title, r.info_author) for r in read_info(rows, None).collect()} == {("", "")}


def test_kept_vectors(spark, tmp_path):
    """Known texts are not encoded again, all rows come back, and models do not mix."""
    folder = str(tmp_path / "cache")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id int, text string")
    encoder = HashingEncoder()
    first = {r.id: r.embedding for r in encode_cached(rows, folder, encoder).collect()}
    assert {k: np.allclose(v, encoder([{1: "a b", 2: "a b", 3: "", 4: "c"}[k]])[0]) for k, v in first.items()} == dict.fromkeys((1, 2, 3, 4), True)

    class Fails(HashingEncoder):
        def __call__(self, texts):
            assert not len(texts) or set(texts) == {"new"}
            return super().__call__(texts)

    more = rows.union(spark.createDataFrame([(5, "new")], "id int, text string"))
    again = {r.id: r.embedding for r in encode_cached(more, folder, Fails()).collect()}
    assert {k: again[k] for k in first} == first and set(again) == {1, 2, 3, 4, 5}
    assert spark.read.parquet(folder).count() == 4

    class Other(HashingEncoder):
        name = "other"

        def __call__(self, texts):
            return -super().__call__(texts)

    other = {r.id: r.embedding for r in encode_cached(rows, folder, Other()).collect()}
    assert other[1] == [-x for x in first[1]]
    assert encode_cached(rows.limit(0), folder, encoder).count() == 0

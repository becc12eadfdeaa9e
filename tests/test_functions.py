"""Single functions and operators on literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from coverlet.config import EngineConfig
from coverlet.functions import fuzzy
from coverlet.functions import scoring as S
from coverlet.functions import text as T
from coverlet.operators import chapters as C
from coverlet.operators import chunks as K
from coverlet.operators import citations as Q
from coverlet.operators import ranking as R
from coverlet.operators import reports as P
from coverlet.operators import syllabus as Y
from coverlet.operators import toc as O
from coverlet.operators import vectors as V
from coverlet.sources.tables import find_files, read_pages


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("e\x0bect", "effect"), ("\x0d ", "\x0d "), ("\x0e\x0fy", "\x0effly"), ("ﬁn ﬆ", "fin st"), ("", ""), ("a\x0cB", "a\x0cB")])
def test_ligatures(spark, text, want):
    assert one(spark, T.fix_ligatures(F.col("t")), t=text) == want


@pytest.mark.parametrize(("word", "want"), [("theories", "theory"), ("ties", "ty"), ("stretching", "stretch"), ("sing", "sing"), ("used", "used"), ("forms", "form"), ("as", "as"), ("boxes", "box")])
def test_stem(spark, word, want):
    assert one(spark, T.stem(F.col("w")), w=word) == want


def test_roman(spark):
    rows = spark.range(1, 4000).select("id", T.roman_to_int(T.int_to_roman(F.col("id"))).alias("back"))
    assert rows.where("id <> back or back is null").isEmpty()
    assert one(spark, T.roman_to_int(F.lit("IIX"))) is None


@pytest.mark.parametrize(("label", "want"), [("UNIT IV", 4), ("Unit 4", 4), ("UNIT-III", 3), ("UNIT : x", 10), ("Part 3", None), ("UNIT IIX", None)])
def test_unit_number(spark, label, want):
    assert one(spark, T.unit_number(F.col("u")), u=label) == want


def test_clean(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" a-\nb  c\r\r(cid:3)\td ") == "ab c\n d"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) == ""


def test_semantic_query(spark):
    ask = T.semantic_query(F.col("t"), F.col("u"))
    assert one(spark, ask, t="Jacobians", u="MULTI-variable o'calculus") == "Jacobians (Multi-Variable O'Calculus)"
    assert one(spark, ask, t="a b c d", u="x") == "a b c d"
    assert one(spark, ask, t="Jacobians", u="UNIT II") == "Jacobians"


def test_scores(spark):
    assert one(spark, S.rescale_semantic(F.lit(0.65))) == pytest.approx(0.5)
    assert [one(spark, S.rescale_semantic(F.lit(x))) for x in (0.1, 0.99)] == [0.0, 1.0]
    assert one(spark, S.combine_scores(*(F.lit(x) for x in (1.0, 1.0, 1.0, 1.0)))) == 100.0
    assert one(spark, S.combine_scores(*(F.lit(x) for x in (-5.0, 0.0, 0.0, 0.0)))) == 0.0
    half = [F.lit(0.5), F.lit(0.05), F.lit(0.0), F.lit(0.1)]
    assert one(spark, S.combine_scores(*half, config=EngineConfig(parity_rounding=True))) == pytest.approx(29.5, abs=0.11)
    assert [one(spark, T.coverage_label(F.lit(x))) for x in (90, 75, 70, 55, 54)] == ["Excellent", "Good", "Moderate", "Tentative", "Weak"]
    assert one(spark, T.rate(F.lit(5), F.lit(8))) == "62%"
    assert one(spark, S.keyword_score(F.array(), F.array(F.lit("a")), F.array(F.lit("a")))) == 0.0


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fuzzy():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(14))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == slow_lcs(a, b)
        short, long = sorted((a, b), key=len)
        windows = [fuzzy.ratio(x, y[max(0, s) : s + len(x)]) for x, y in ((short, long), (long, short))[: 1 + (len(a) == len(b))] for s in range(1 - len(x), len(y))]
        assert not short or fuzzy.partial_ratio(a, b) == pytest.approx(max(windows))
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.partial_ratio("bear", "the bear was") == 100.0
    assert 0 <= fuzzy.weighted_ratio("abc def", "abc") <= 100


def test_match_score():
    book = ("advanced topics in flow", "Maria Keller", "flow_keller.pdf")
    assert Q.match_score('Keller M., "Advanced Topics in Flow", Press, 2019', *book) > 70
    assert Q.match_score('Otto Zyx, "Advanced Topics in Flow", Press, 2019', *book) == 0.0
    assert Q.match_score("", *book) == 0.0


@pytest.mark.parametrize(
    ("line", "units", "sections"),
    [
        ("A, B. [For Units II & IV - Sections 1.1, 2.3 to 2.5 (part), 7.1 - 7.2 and 9.8].", [2, 4], ["1.1", "2.3", "2.4", "2.5", "7.1", "7.2", "9.8"]),
        ("A [For Units I to III]", [1, 2, 3], []),
        ("A [Sections 3.1, 4.2 to 5.1]", [], ["3.1", "4.2", "5.1"]),
        ("A [x] B [For Unit 5]", [5], []),
        ("A [For Unit 5] [online]", [], []),
        ("A, B, 2019", [], []),
        (None, [], []),
    ],
)
def test_citation_scope(line, units, sections):
    assert Q.citation_scope(line) == (units, sections)


def test_resolve_in_blocks(spark):
    books = [(k, f"B{k}", f"title number {k}", f"author{k} x", "f.pdf") for k in range(7)]
    catalog = spark.createDataFrame(books, "book_seq long, book_key string, title string, authors string, filename string")
    lines = [(k, f'Author{k} X, "Title Number {k}", 2001') for k in range(7)] + [(8, "nothing like it"), (9, None)]
    cites = spark.createDataFrame(lines, "cite_seq int, raw_line string")
    got = [sorted(map(tuple, Q.resolve(cites, catalog, EngineConfig(catalog_rows=n)).collect())) for n in (100, 3)]
    assert got[0] == got[1]
    assert {r[0]: r[2] for r in got[0]} == {k: f"B{k}" for k in range(7)} | {8: None, 9: None}


def _by_brute_force(books, line):
    top = (0.0, None)
    for _, key, title, authors, filename in books:
        score = Q.match_score(line or "", title or "", authors or "", filename or "")
        if score > top[0]:
            top = (score, key)
    return (top[1] if top[0] >= EngineConfig().resolve_score else None, top[0])


def test_resolve_like_brute_force(spark):
    rng = random.Random(5)
    words, names = ["large", "ring", "hot", "bolt", "blue", "of", "flow"], ["Maker1 brand#2", "Maker12 brand#21", "Maker3 brand#7", "Otto Zyx", "", None]
    title = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3)))
    books = [(k, f"B{k}", rng.choice([title(), title(), title(), "", None]), rng.choice(names), rng.choice(["a.pdf", title(), None])) for k in range(60)]
    lines = [f'{(rng.choice(names) or "").upper()}, "{title()}", Press, 2019.' for _ in range(60)] + [f"{title()} By {rng.choice(names)}" for _ in range(20)] + [title() for _ in range(20)] + ["", None]
    catalog = spark.createDataFrame(books, "book_seq long, book_key string, title string, authors string, filename string")
    cites = spark.createDataFrame(list(enumerate(lines)), "cite_seq int, raw_line string")
    for n in (100, 7):
        got = {r.cite_seq: (r.book_key, r.match_score) for r in Q.resolve(cites, catalog, EngineConfig(catalog_rows=n)).collect()}
        assert got == {k: _by_brute_force(books, x) for k, x in enumerate(lines)}


def test_citation_resolve_is_whole(spark):
    """A part that no other part equals in name, size and brand is cited as itself."""
    from coverlet.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/part.parquet").collect()
    books = [(r.p_partkey, f"B{r.p_partkey}", r.p_name.title(), f"Maker{r.p_size} {r.p_brand.lower()}", f"{r.p_name}.pdf") for r in sorted(parts, key=lambda r: r.p_partkey)]
    got = {r.cite_seq: (r.book_key, r.match_score) for r in QUERIES["citation_resolve"](spark, folder).collect()}
    lines = {r.p_partkey: f'MAKER{r.p_size} {r.p_brand.upper()}, "{r.p_name}", Press, 2019.' for r in parts}
    assert got == {k: _by_brute_force(books, x) for k, x in lines.items()}
    assert any(int(key[1:]) >= 60 for key, _ in got.values() if key)


def test_page_offset_drift_is_whole(spark):
    """Every line of every order, against brute force."""
    from coverlet.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    orders: dict = {}
    for r in sorted(spark.read.parquet(f"{folder}/lineitem.parquet").collect(), key=lambda r: (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity)):
        orders.setdefault(r.l_orderkey, []).append(r)
    want = {}
    for order, lines in orders.items():
        page, entries, heads = 0, [], {}
        for seq, r in enumerate(lines):
            page += r.l_quantity
            entries.append((seq, f"head {r.l_partkey}", int(page)))
            at = int(page) - 1 + order % 3 + (r.l_linenumber == 7)
            heads[at] = max(heads.get(at, ""), f"head {r.l_partkey}")
        last = max(p for *_, p in entries) + 1
        heads.setdefault(last, "")
        found, votes = {}, {}
        for seq, title, page in entries:
            scored = [(fuzzy.partial_ratio(title, head), -off) for off in range(-3, 46) if (head := heads.get(page - 1 + off))]
            score, own = max((x for x in scored if x[0] > 0), default=(None, 0))
            found[seq] = score, -own
            if score is not None and score >= 70:
                n, first = votes.get(-own, (0, -seq))
                votes[-own] = n + 1, first
        everywhere = max(((n, first, own) for own, (n, first) in votes.items()), default=(0, 0, 0))[2]
        for seq, _, page in entries:
            score, own = found[seq]
            offset = own if score is not None and score >= 85 and abs(own - everywhere) <= 3 else everywhere
            want[order, seq] = offset, page - 1 + offset if 0 <= page - 1 + offset <= max(heads) else None
    got = {(r.doc_key, r.seq): (r.offset, r.pdf_page) for r in QUERIES["page_offset_drift"](spark, folder).collect()}
    assert got == want


def test_every_order_is_a_unit(spark):
    """The parsers find all orders of a customer in the texts that the queries without a cap read."""
    from coverlet.plans import syllabus_queries as U

    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").join(spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_orderkey as o_orderkey").distinct(), "o_orderkey")
    want = {f"c/{r.o_custkey}.pdf": r["count"] for r in orders.groupBy("o_custkey").count().collect()}
    got = {r.source_file: r.n_units for r in Y.subject_qa(U._texts(spark, folder).select("source_file", "text")).collect()}
    assert got == want and max(want.values()) > 5


def test_toc(spark):
    text = "CONTENTS\niv\nPreface\n1.2 Long title\nthat wraps ..... 12\nCHAPTER 3 Flow   45\n6 .... 9999\n\n" + "w " * 30 + "\nAPPENDIX TABLES 300\n7"
    rows = O.toc_entries(spark.createDataFrame([("d", text), ("e", None)], "doc_key string, text string")).orderBy("seq").collect()
    assert [(r.label, r.title, r.page, r.level) for r in rows] == [("", "Preface 1.2 Long title that wraps", 12, 2), ("CHAPTER 3", "Flow", 45, 1), ("", ("w " * 30).strip() + " APPENDIX TABLES", 300, 2)]


def model_chapters(entries, num_pages):
    """A plain loop over entries (label, title, level, page)."""
    kept = []
    for e in entries:
        if e[3] is not None and (not kept or e[3] >= kept[-1][3]):
            kept.append(e)
    out, number = [], None
    for k, (label, title, level, page) in enumerate(kept):
        end = max(page, (kept[k + 1][3] if k + 1 < len(kept) else num_pages) - 1)
        digits = label.split()[-1] if label else ""
        chap = digits if level <= 1 and digits.isdigit() else None
        sec = label.split(".")[0] if level > 1 and "." in label else None
        if level <= 1:
            out.append([label, title, page, end, []])
            number, explicit = chap, chap is None
        else:
            if not out:
                out.append([sec or label, "" if sec else title, page, end, []])
                number, explicit = sec, False
                if sec is None:
                    continue
            elif sec is not None and sec != number and not explicit:
                out.append([sec, "", page, end, []])
                number = sec
            out[-1][4].append(label)
            out[-1][3] = max(out[-1][3], end)
    return [tuple(x[:4]) + (tuple(x[4]),) for x in out]


def test_chapters_against_a_loop(spark):
    rng, docs, rows = random.Random(5), {}, []
    for d in range(60):
        entries, page = [], 0
        for seq in range(rng.randrange(1, 12)):
            level = rng.choice((1, 2, 2))
            label = rng.choice(("", f"Chapter {rng.randrange(1, 4)}")) if level == 1 else rng.choice((f"{rng.randrange(1, 4)}.{seq}", f"{rng.randrange(1, 3)}.1", ""))
            page += rng.choice((0, 1, 5, -3))
            at = rng.choice((page, page, None))
            entries.append((label, f"t{seq}", level, at))
            rows.append((str(d), seq, label, f"t{seq}", 1 + (at or 0), level, at, 50))
        docs[str(d)] = model_chapters(entries, 50)
    frame = spark.createDataFrame(rows, "doc_key string, seq int, label string, title string, page int, level int, pdf_page int, num_pages int")
    got = {}
    for r in C.build_chapters(C.entry_ranges(C.monotone_pages(frame))).orderBy("doc_key", "chapter_no").collect():
        got.setdefault(r.doc_key, []).append((r.label, r.title, r.page_start, r.page_end, tuple(s.label for s in r.sections)))
    assert got == {k: v for k, v in docs.items() if v}


@pytest.mark.parametrize(("n", "config"), [(0, {}), (50, {}), (350, {}), (351, {}), (1000, {}), (1200, {}), (13, {"window_words": 5, "overlap_words": 0, "least_words": 4}), (10, {"window_words": 5, "overlap_words": 1, "least_words": 4})])
def test_subchunks(spark, n, config):
    config = EngineConfig(**config)
    words = [f"w{k}" for k in range(n)]
    step, want, start = config.window_words - config.overlap_words, [], 0
    while start < n:
        want.append(words[start : start + config.window_words])
        if start + config.window_words >= n:
            break
        start += step
    if len(want) > 1 and len(want[-1]) < config.least_words:
        want[-2:] = [want[-2] + want[-1]]
    frame = spark.createDataFrame([("c", "A", "", " ".join(words))], "id string, chapter_title string, section_title string, text string")
    got = K.subchunks(frame, "id", config=config).orderBy("idx").collect()
    assert [(r.text, r.word_count) for r in got] == ([(" ".join(["A.", *w]), len(w)) for w in want] or [("A.", 0)])


def test_standardize_twice(spark):
    text = "MODULE 2 X\nAIM\nPrescribed Books:\nSuggested Readings\n• a\n● b\x0cPTMA3151 Book(s) nb\xa0sp\nS-Strong; M-Medium; L-Low\nSYLLABUS\nWATER 1\ntext\nOUTCOMES"
    first = Y.standardize(spark.createDataFrame([(1, text), (2, None)], "k int, text string"))
    rows = {r.k: r for r in first.collect()}
    assert rows[1].text.startswith("UNIT 2 X\nOBJECTIVES:\nTEXT BOOKS:\nREFERENCE BOOKS:\n – a\n – b\nMA3151 BOOKS nb sp")
    assert rows[1].changes["bullet_marker"] == 2
    assert rows[2].text == ""
    assert "UNIT 1 WATER 1" in rows[1].text
    again = {r.k: r for r in Y.standardize(first.select("k", "text")).collect()}
    assert again[1].text == rows[1].text
    assert not again[1].changes


def test_eponyms_against_a_loop(spark):
    import re

    rng, choices = random.Random(9), ["Gram", "Schmidt method", "Cauchy", "Laplace law", "Methods", "plain text", "Taylor", "Fourier series", "X1"]
    lone, thing = re.compile(r"^[A-Z][A-Za-z’'.]+$"), re.compile(r"^[A-Z][A-Za-z’'.]+\b.*\b(method|law|series)\b")
    rows = [(k, [rng.choice(choices) for _ in range(rng.randrange(9))]) for k in range(200)]

    def model(topics):
        out, k = [], 0
        while k < len(topics):
            if k + 1 < len(topics) and lone.match(topics[k]) and topics[k] != "Methods" and thing.match(topics[k + 1]):
                out.append(f"{topics[k]}-{topics[k + 1]}")
                k += 1
            else:
                out.append(topics[k])
            k += 1
        return out

    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, t array<string>").select("k", Y.merge_eponyms(F.col("t")).alias("m")).collect()}
    assert got == {k: model(t) for k, t in rows}


def test_units_and_titles(spark):
    text = "UNIT – I  MATRICES  9 + 0\nA – Cayley - Hamilton theorem – 12 – b.\nUNIT II\nWRAPPED TITLE – c - d\nUNIT III 9\nTEXT BOOKS:\n1  2 \n"
    rows = Y.units(spark.createDataFrame([("f", "c", text)], "source_file string, code string, block string")).orderBy("unit_seq").collect()
    assert [(r.unit_number, r.unit_title, r.topics) for r in rows] == [(1, "MATRICES", ["A", "Cayley-Hamilton theorem", "b"]), (2, "WRAPPED TITLE – c - d", []), (3, "9", [])]
    topics = Y.explode_topics(spark.createDataFrame([("f", "c", 0, "UNIT I", 1, "T", [])], "source_file string, code string, unit_seq int, unit_label string, unit_number int, unit_title string, topics array<string>"))
    assert topics.first().topic == "T"


def test_pools(spark):
    rows = [(1, "a", 0, 0, 60.0), (1, "b", 1, 1, 80.0), (2, "a", 0, 0, 71.0), (2, "b", 1, 1, 99.0), (3, "a", 0, 1, 56.0), (3, "b", 1, 0, 56.0), (4, "a", 0, 0, 10.0), *((5, f"k{k}", 0, k, 90.0) for k in range(5))]
    best = spark.createDataFrame(rows, "t int, book string, pool int, key_seq int, coverage double")
    got = sorted((r.t, r.book, r.status) for r in R.top_books(best, ("t",), "pool").collect())
    assert got == [(1, "b", "Found"), (2, "a", "Found"), (3, "a", "Tentative"), (5, "k0", "Found"), (5, "k1", "Found"), (5, "k2", "Found")]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(k, "s", f"c{k % 2}", "n", "Found" if k % 2 else "Not Found", "bad\x01") for k in range(5)], "seq int, syllabus_name string, subject_code string, subject_name string, status string, notes string")
    lines = P.summary(rows).collect()
    assert [(r.syllabus, r.total, r.coverage_rate) for r in lines] == [("s", 3, "0%"), ("s", 2, "100%"), ("TOTAL", 5, None)]
    full = rows
    for name, _ in P.P.REPORT_COLUMNS:
        if name not in full.columns:
            full = full.withColumn(name, F.lit(1 if "page" in name else "x"))
    P.write_workbook(full, str(tmp_path / "r.xlsx"))
    P.write_report(full, str(tmp_path / "out"), "csv")
    assert (tmp_path / "r.xlsx").stat().st_size > 500
    assert spark.read.option("header", True).csv(str(tmp_path / "out/recommendations")).count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"p0\fp1")
    (tmp_path / "sub" / "b.txt").write_bytes(b"q0")
    (tmp_path / "c.pdf").write_bytes(b"x")
    files = find_files(spark, str(tmp_path), ".txt").withColumn("doc_key", T.file_stem(F.col("path")))
    assert sorted((r.doc_key, r.page_no, r.text) for r in read_pages(files).collect()) == [("a", 0, "p0"), ("a", 1, "p1"), ("b", 0, "q0")]
    assert find_files(spark, str(tmp_path), ".txt", recursive=False).count() == 1

    def fails(content):
        raise ValueError("no")

    assert {r.error for r in read_pages(files, fails).collect()} == {"ValueError: no"}


def test_encoder():
    assert V.encoder_works(V.HashingEncoder(), ("heat flow in metals", "flow of heat"), ("heat flow in metals", "poems of spring"))


def test_encoder_by_definition():
    """Signed counts of words by their hash, text by text, over more texts than are held at once."""
    import numpy as np
    import xxhash

    rng = random.Random(5)
    texts = ["", "  ", *(" ".join(f"W{rng.randint(0, 60)}" for _ in range(rng.randint(0, 40))) for _ in range(V.TEXTS_AT_ONCE + 40))]
    got = V.HashingEncoder(16)(texts)
    for text, row in zip(texts, got, strict=True):
        want = np.zeros(16)
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word)
            want[h % 16] += 1 if h >> 63 else -1
        norm = np.sqrt((want**2).sum())
        assert row == pytest.approx(want / (norm or 1), abs=1e-6)
    assert V.HashingEncoder()([]).shape == (0, 64)


def test_dot_of_odd_vectors(spark):
    """Null vectors, null places and unequal lengths give null, empty vectors 0."""
    pairs = [([1.0, 2.0], [3.0, 4.0], 11.0), (None, [1.0], None), ([1.0], None, None), ([1.0, None], [1.0, 2.0], None), ([], [], 0.0), ([1.0], [1.0, 2.0], None), ([0.5, -2.0, 4.0], [2.0, 1.0, 0.25], 0.0)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<float>, b array<float>, want double")
    assert [(r.got, r.want) for r in rows.select("want", S.dot(F.col("a"), F.col("b")).alias("got"), "k").orderBy("k").collect()] == [(p[2], p[2]) for p in pairs]


def test_partial_ratio_by_definition():
    """The best ratio over every stretch of the longer text as long as the shorter one, and the shorter ones at its ends."""
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcde ") for _ in range(rng.randint(1, n))) for n in (7, 16))
        short, long = sorted((a, b), key=len)
        sides = [(short, long)] if len(a) != len(b) else [(a, b), (b, a)]
        want = max(fuzzy.ratio(s, t[k:m]) for s, t in sides for k in range(len(t)) for m in range(k + 1, min(k + len(s), len(t)) + 1) if m - k == len(s) or k == 0 or m == len(t))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(want)


def test_white_space(spark):
    """Every code point that is white space in Python splits and is stripped, and no other."""
    codes = [k for k in range(0x10000) if not 0xD800 <= k <= 0xDFFF]
    rows = spark.createDataFrame([(k, f"{chr(k)}a{chr(k)}b{chr(k)}") for k in codes], "k int, t string")
    got = rows.select("k", F.size(T.words(F.col("t"))).alias("n"), F.length(T.strip(F.col("t"))).alias("m")).collect()
    assert [(r.k, r.n, r.m) for r in sorted(got)] == [(k, 2, 3) if chr(k).isspace() else (k, 1, 5) for k in codes]

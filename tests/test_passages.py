"""Passages scored by blocks, against every pair by itself; and what recommend_full asks for."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coverlet.config import EngineConfig
from coverlet.functions.fuzzy import TokenSetRatio, token_set_ratio
from coverlet.operators import passages
from coverlet.operators.ranking import TOPIC, score_candidates, with_stems
from coverlet.operators.vectors import HashingEncoder
from coverlet.plans import QUERIES

CONFIG = EngineConfig(similarity_floor=0.0, similarity_ceiling=0.7)
WORDS = "heat flow walls fluid plates Heat gases energy boundary layers Poems spring waves moving solid".split()
SECTIONS = ["1.1", "1.2"]


def scored(topic, query, stems, chunk, windows, unit, by_section):
    """A pair's percentage by the definitions."""
    near = max(sum(float(a) * float(b) for a, b in zip(query, w, strict=True)) for w in windows)
    semantic = min(1.0, max(0.0, near / 0.7))
    title, body = set(chunk.title_stems), set(chunk.body_stems)
    hits = sum(2 if s in title else s in body for s in stems)
    keyword = min(1.0, hits / (2 * len(stems))) if stems else 0.0
    total = 0.55 * semantic + 0.2 * keyword + 0.15 * token_set_ratio(topic, chunk.chunk_title) / 100 + 0.1 * 0.75
    percent = int(min(1.0, total) * 1000 + 0.5) / 10
    return percent * unit * (0.94 if by_section and chunk.section_label not in SECTIONS else 1.0)


@pytest.mark.parametrize("rows", [7, 512])
def test_best_of_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(passages, "BLOCK_ROWS", rows)
    rng, encoder = random.Random(5), HashingEncoder(16)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    topics = [("s.txt", code, k % 2, k, k % 2 + 1, "UNIT", say(k + 1)) for code in "AB" for k in range(8)]
    cited = [("s.txt", "A", "textbook", "b0", 0), ("s.txt", "A", "reference", "b1", 1), ("s.txt", "B", "textbook", "b1", 0), ("s.txt", "B", "textbook", "none", 1)]
    scopes = [("s.txt", "A", "b0", ([1], SECTIONS)), ("s.txt", "B", "b1", ([], ["9.9"]))]
    chunks = [(f"b{k % 3}", k, f"c{k}", say(3) if k % 7 else "", "", f"1.{k % 4}", say(40) if k % 11 else "heat " * 9) for k in range(120)]
    windows = [(c[0], c[2], w) for c in chunks for w in (c[6], say(5), say(9))[: c[1] % 3 + 1]]
    frame = spark.createDataFrame
    chunk_rows = frame(chunks, "book_key string, chunk_seq int, chunk_id string, chapter_title string, section_title string, section_label string, text string")
    vectors = [(b, c, [float(x) for x in encoder([w])[0]]) for b, c, w in windows]
    found = score_candidates(
        frame(topics, "source_file string, code string, unit_seq int, topic_seq int, unit_number int, unit_title string, topic string"),
        frame(cited, "source_file string, code string, citation_type string, book_key string, key_seq int"),
        frame(scopes, "source_file string, code string, book_key string, scope struct<units array<int>, sections array<string>>"),
        chunk_rows, frame([(f"b{k}", "t", "a", "", "2001") for k in range(3)], "book_key string, title string, authors string, edition string, year string"),
        frame(vectors, "book_key string, chunk_id string, embedding array<float>"), encoder, CONFIG,
    )
    got = {(*(r[c] for c in TOPIC), r.citation_type, r.book_key): (r.coverage, r.chunk_id) for r in found.collect()}
    stemmed = with_stems(chunk_rows.withColumn("x", F.lit(0))).collect()
    asked = with_stems(frame([(t[6], "", t[6]) for t in topics], "chapter_title string, section_title string, text string")).collect()
    stems = {r.text: r.body_stems for r in asked}
    want = {}
    for s, code, unit, seq, number, _, topic in topics:
        query = encoder([CONFIG.query_prefix + topic])[0]
        for book, kind in [(c[3], c[2]) for c in cited if c[1] == code and c[3] != "none"]:
            allowed = 0.9 if (code, book) == ("A", "b0") and number != 1 else 1.0
            pairs = [(-scored(topic, query, stems[topic], c, [v for b, i, v in vectors if i == c.chunk_id], allowed, (code, book) == ("A", "b0")), c.chunk_id) for c in stemmed if c.book_key == book]
            want[s, code, unit, seq, kind, book] = min(pairs)
    assert set(got) == set(want)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] + want[k][0]) < 0.051 for k in want)


def test_pairs_that_cannot_win_are_not_written():
    """Of 600 chunks and 20 topics, and of copies, few pairs leave a task."""
    rng, encoder = random.Random(7), HashingEncoder(16)
    names = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choices(names, k=n))
    texts = [say(12) for _ in range(20)]
    pairs = pa.table({"seq": range(20), "book_key": ["b"] * 20, "topic": texts, "query": texts, "unit": [1.0] * 20, "sections": pa.array([[]] * 20, pa.list_(pa.string())), "by_section": [False] * 20, "meta": [1.0] * 20})
    known = pa.table({"topic": texts, "query": texts, "topic_stems": [t.split() for t in texts], "query_embedding": pa.array(list(encoder(texts)), pa.list_(pa.float32()))})
    held = passages.Asked(pairs, known, ["seq"], CONFIG)

    def rows(bodies):
        titles = [b.split()[:2] for b in bodies]
        columns = {
            "book_key": ["b"] * len(bodies), "chunk_id": [f"c{k}" for k in range(len(bodies))], "chunk_seq": range(len(bodies)), "section_label": ["1"] * len(bodies), "chunk_title": [" ".join(t) for t in titles],
            "title_stems": titles, "body_stems": [sorted(set(b.split())) for b in bodies], "embeddings": pa.array([[v] for v in np.array(encoder(bodies))], pa.list_(pa.list_(pa.float32()))),
        }
        return pa.RecordBatch.from_pydict(columns)

    assert sum(b.num_rows for b in held.candidates(iter([rows([say(30) for _ in range(600)])]))) < 20 * 600 / 20
    copies = list(held.candidates(iter([rows([say(30)] * 500)])))
    assert sum(b.num_rows for b in copies) == 20 and set(copies[0]["chunk_id"].to_pylist()) == {"c0"}


def test_one_text_with_many():
    """Few short tokens, so that texts share all, some or none of them."""
    rng, names = random.Random(1), ["ab", "b", "abc", "ñe", "é", "cab", "a", "bb", "acb", "x"]
    for _ in range(3000):
        a, b = (" ".join(rng.choices(names, k=rng.randint(0, n))) for n in (9, 6))
        assert TokenSetRatio(a)(b) == token_set_ratio(a, b)

def test_recommend_full_asks_for_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    told = {r.topic for r in QUERIES["recommend_full"](spark, folder).select("topic").distinct().collect()}
    assert told == {r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}

"""Chunks of books scored against all topics that ask for their book, block by block: pairs that cannot win are never written."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..config import EngineConfig
from ..functions.fuzzy import TokenSetRatio

#: Chunks of a block, and at most so many cells of its matrices.
BLOCK_ROWS, BLOCK_CELLS = 512, 1 << 20
#: Percent by which a pair may be below another one and still equal it when both are rounded to one decimal.
SLACK = 0.11
#: Times that each topic's likeliest chunk is compared alone, before all that are left are.
ROUNDS = 4


def _incidence(sets: list) -> tuple[pa.Array, np.ndarray]:
    """(the members of all sets, a matrix of members by sets)."""
    known = {w: k for k, w in enumerate(dict.fromkeys(w for s in sets for w in s))}
    out = np.zeros((len(known), len(sets)), np.float32)
    for k, s in enumerate(sets):
        out[[known[w] for w in s], k] = 1
    return pa.array(list(known), pa.string()), out


def _places(lists: pa.Array, members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of the lists' entries that are members."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=members), -1).to_numpy(zero_copy_only=False)
    found = at >= 0
    return np.repeat(np.arange(len(lists)), size)[found], at[found]


def _joined(count: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Length of so many words with so many letters, joined by spaces."""
    return letters + np.maximum(count - 1, 0)


class Texts:
    """Some topics' texts as columns of matrices: their stems, words and vectors."""

    def __init__(self, texts: pa.Table):
        self.texts = texts["topic"].to_pylist()
        stems = texts["topic_stems"].to_pylist()
        self.stems, self.stem_at = _incidence(stems)
        self.stem_count = np.array([len(s) for s in stems], float)
        words = [set(t.split()) for t in self.texts]
        self.words, self.word_at = _incidence(words)
        self.letters = np.array([len(w) for w in self.words.to_pylist()], np.float32)
        self.word_count, self.letter_count = (np.array([f(w) for w in words], float) for f in (len, lambda w: sum(map(len, w))))
        self.ratios = [lru_cache(1 << 8)(TokenSetRatio(t)) for t in self.texts]
        self.vectors = np.array(texts["query_embedding"].to_pylist(), np.float64).reshape(len(words), -1)

    def keyword(self, title: pa.Array, body: pa.Array) -> np.ndarray:
        """A topic's stem in the title counts two, in the body alone one, of two each."""
        weight = np.zeros((len(title), len(self.stems)), np.float32)
        weight[_places(body, self.stems)] = 1
        weight[_places(title, self.stems)] = 2
        hits = (weight @ self.stem_at).astype(float)
        return np.minimum(1.0, hits / np.maximum(2 * self.stem_count, 1))

    def similarity(self, windows: pa.Array) -> np.ndarray:
        """The best dot product of a chunk's windows, summed in order."""
        size = pc.list_value_length(windows).to_numpy(zero_copy_only=False)
        vectors = windows.flatten()
        places = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        total = np.zeros((len(vectors), len(self.texts)))
        for a, b in zip(np.ascontiguousarray(places.T), np.ascontiguousarray(self.vectors.T), strict=True):
            total += np.multiply.outer(a, b)
        return np.maximum.reduceat(total, np.cumsum(size) - size, axis=0)

    def likeness(self, titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the titles' token-set likeness, 0 to 1: without a common subsequence of the rests, and with the longest."""
        words = [list(set(t.split())) for t in titles]
        has = np.zeros((len(titles), len(self.words)), np.float32)
        has[_places(pa.array(words, pa.list_(pa.string())), self.words)] = 1
        k, c = (m.astype(float) for m in (has @ self.word_at, (has * self.letters) @ self.word_at))
        count, letters = (np.array([f(w) for w in words], float)[:, None] for f in (len, lambda w: sum(map(len, w))))
        common, gap = _joined(k, c), (k > 0).astype(float)
        rest_a, rest_b = _joined(self.word_count - k, self.letter_count - c), _joined(count - k, letters - c)
        whole_a, whole_b = common + gap + rest_a, common + gap + rest_b
        real = (count > 0) & (self.word_count > 0)
        side = 2 * common / np.maximum(common + np.minimum(whole_a, whole_b), 1)
        of = lambda shared: np.where(real, np.maximum(side, 2 * (common + gap + shared) / np.maximum(whole_a + whole_b, 1)), 0.0)
        same = real & (k > 0) & ((rest_a == 0) | (rest_b == 0))
        return np.where(same, 1.0, of(0.0)), np.where(same, 1.0, of(np.minimum(rest_a, rest_b)))


class Asked:
    """What is asked of each book.

    pairs: (keys, book_key, topic, query, unit, sections, by_section, meta), one row a topic and cited book; texts:
    (topic, query, topic_stems, query_embedding).
    """

    def __init__(self, pairs: pa.Table, texts: pa.Table, keys: list[str], config: EngineConfig):
        row = {t: k for k, t in enumerate(zip(texts["topic"].to_pylist(), texts["query"].to_pylist(), strict=True))}
        text = [row[t] for t in zip(pairs["topic"].to_pylist(), pairs["query"].to_pylist(), strict=True)]
        self.pairs = pairs.drop_columns(["topic", "query"]).append_column("text", pa.array(text, pa.int64())).combine_chunks()
        self.texts, self.keys, self.config = texts.combine_chunks(), keys, config
        self.books: dict[str, list[int]] = {}
        for k, book in enumerate(pairs["book_key"].to_pylist()):
            self.books.setdefault(book, []).append(k)

    def candidates(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(keys, book_key, chunk_id, chunk_seq, semantic, keyword, fuzzy, meta, unit, section): for each pair the chunks
        that may be the best of its book, from all that the batches hold. Of equal ones the first by chunk_id suffices.
        """
        texts: dict[bytes, Texts] = {}
        books: dict[str, Book] = {}
        for batch in batches:
            names = batch.column("book_key").dictionary_encode()
            code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                name = names[int(rows[0])].as_py() if len(rows) else None
                if name not in self.books:
                    continue
                if name not in books:
                    books[name] = Book(self, self.books[name], texts)
                book = books[name]
                step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // len(book.at)))
                for start in range(0, len(rows), step):
                    if (found := book.block(batch.take(pa.array(rows[start : start + step])))) is not None:
                        yield found


class Book:
    """The topics that ask for one book, each with the least percentage that its best chunk has at any rate."""

    def __init__(self, asked: Asked, at: list[int], texts: dict[bytes, Texts]):
        self.asked, self.at = asked, np.array(at)
        rows = asked.pairs.take(pa.array(at))
        needed, self.text = np.unique(rows["text"].to_numpy(), return_inverse=True)
        if (key := needed.tobytes()) not in texts:
            texts[key] = Texts(asked.texts.take(pa.array(needed)))
        self.texts = texts[key]
        self.unit, self.meta = (rows[c].to_numpy() for c in ("unit", "meta"))
        kinds: dict[tuple, int] = {}
        each = zip(rows["by_section"].to_pylist(), rows["sections"].to_pylist(), strict=True)
        self.kind = np.array([kinds.setdefault(tuple(s) if by else (), len(kinds)) for by, s in each])
        self.kinds = [set(s) for s in kinds]
        self.bar = np.full(len(at), -np.inf)

    def block(self, chunks: pa.RecordBatch) -> pa.RecordBatch | None:
        config, col = self.asked.config, chunks.column
        low, high = config.similarity_floor, config.similarity_ceiling
        near = self.texts.similarity(col("embeddings"))
        semantic = np.clip((near - low) / (high - low) if high > low else near, 0.0, 1.0)[:, self.text]
        keyword = self.texts.keyword(col("title_stems"), col("body_stems"))[:, self.text]
        titles, labels = col("chunk_title").to_pylist(), col("section_label").to_pylist()
        outside = [[bool(s) and label is not None and label not in s for s in self.kinds] for label in labels]
        section = np.where(np.array(outside), config.out_of_section, 1.0)[:, self.kind]
        total = lambda s, k, f, m: np.clip(config.weight_semantic * s + config.weight_keyword * k + config.weight_fuzzy * f + config.weight_metadata * m, 0.0, 1.0) * 100
        least, most = (total(semantic, keyword, f[:, self.text], self.meta) * self.unit * section for f in self.texts.likeness(titles))
        self.bar = np.maximum(self.bar, least.max(0))

        known = np.full(most.shape, np.nan)  # the likeness where it has been worked out

        def compare(i: np.ndarray, p: np.ndarray) -> None:
            known[i, p] = [self.texts.ratios[t](titles[k]) / 100 for k, t in zip(i.tolist(), self.text[p].tolist(), strict=True)]
            most[i, p] = total(semantic[i, p], keyword[i, p], known[i, p], self.meta[p]) * self.unit[p] * section[i, p]
            np.maximum.at(self.bar, p, most[i, p])

        for turn in range(ROUNDS + 1):
            open_ = np.isnan(known) & (most >= self.bar - SLACK)
            if not open_.any():
                break
            if turn < ROUNDS:
                p = np.flatnonzero(open_.any(0))
                compare(np.where(open_, most, -np.inf).argmax(0)[p], p)
            else:
                compare(*np.nonzero(open_))
        i, p = np.nonzero(~np.isnan(known) & (most >= self.bar - SLACK))
        # Equal scores stay equal: the first chunk id stands for all.
        ids = col("chunk_id").to_pylist()
        rank = np.empty(len(ids), int)
        rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        order = np.lexsort((rank[i], section[i, p], most[i, p], p))
        i, p = i[order], p[order]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(p) != 0) | (np.diff(most[i, p]) != 0) | (np.diff(section[i, p]) != 0)
        i, p = i[new], p[new]
        if not len(i):
            return None
        held = {c: self.asked.pairs[c].combine_chunks().take(pa.array(self.at[p])) for c in [*self.asked.keys, "book_key"]}
        held |= {c: col(c).take(pa.array(i)) for c in ("chunk_id", "chunk_seq")}
        scores = {"semantic": semantic[i, p], "keyword": keyword[i, p], "fuzzy": known[i, p], "meta": self.meta[p], "unit": self.unit[p], "section": section[i, p]}
        return pa.RecordBatch.from_pydict(held | {c: pa.array(v) for c, v in scores.items()})

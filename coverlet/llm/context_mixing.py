"""Scores of whole texts by online logistic context mixing.

A text is its words and one end token. A token is coded by binary decisions. First, whether it is one of the tokens
that followed the last two words in the training texts; if not, whether it is one that followed the last word; a
token that did costs its share of what followed. Otherwise its bucket (a 10-bit hash of its first bytes) is coded bit
by bit, then the token within its bucket, by its count in the training tokens (one place is for unseen tokens). Each
binary decision has several predictors, each with counts under its own hashed context; they are stretched, combined
by weights that a gate selects, squashed, and refined by an adaptive table. Weights, the refinement and the document's
own counts follow the text as it is read. The sum over a text is its log-probability.

What is learned from the corpus: counts of all training tokens, pairs and triples of tokens, which grow with the input
and stay distributed, and the bucket predictors' counts in tables of fixed size. Counts of pairs and triples are looked
up by hash: each chunk of texts sends its sorted distinct keys to shards by hash range, a shard adds the chunks' counts
and replies to each chunk, so a common key is one entry a chunk and no key is hot. A training text is scored by what
the other texts have: its own pairs and triples are taken away first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, integral, mix, pieces, stored, texts_of, words_of

DEPTH = 10
SYMBOLS = 1 << DEPTH
#: Contexts of each bucket predictor: none, the last bucket, the last two, the last word's ending, the bucket before the last.
CONTEXTS = (1, SYMBOLS, 2 * SYMBOLS, SYMBOLS, SYMBOLS)
OFFSETS = np.cumsum((0, *CONTEXTS))[:-1]
ROWS = sum(CONTEXTS)
#: The bytes that choose a bucket, and the ending that serves as context.
HEAD, TAIL = 3, 3
END = b"\n"
#: Bounds of one chunk: its tokens, and its documents as a power of two.
CHUNK, DOC_BITS = 3 << 18, 12
#: Rows of counts that travel together, and tables of one group that are summed by one task.
BLOCK_ROWS, FAN_IN = 64, 64
#: How counts are written: they are compressed already, and a task that writes or reads them holds a group of rows.
GROUP_BYTES = 4 << 20
WRITTEN = {"compression": "none"} | {f"parquet.{what}.size.row.check.{end}": rows for what in ("block", "page") for end, rows in (("min", 8), ("max", 16))}
#: Level at which numbers are compressed: 2 % smaller than at 1.
LEVEL = 5
#: Bytes of text whose keys one shard holds, about.
SHARD_BYTES = 8 << 20
#: Bits of a word's key; of the key of a pair or triple beyond those that tell the training tokens apart, and the most.
WORD_BITS, SPARE_BITS, MOST_BITS = 60, 6, 64 - DOC_BITS
#: Tokens of a document's first block; each later block is as long as all before it, up to STRIDE.
FIRST, STRIDE = 16, 64
#: The bucket predictors' starting weights (the last is the document's own counts), learning rate, gates and refinement.
WEIGHTS = np.array([0.05, 0.35, 0.3, 0.3, 0.3, 0.3], np.float32)
LEARN, GATES, BUCKETS, TRUST = 0.02, 3, 24, 200.0
#: How much the counts of all training tokens weigh against a document's own.
PRIOR = 6.0
#: Levels of how often a context was seen; the decision's predictors: by level, by the last decisions, by both.
LEVELS, PAST = 8, 8
FLAG_CONTEXTS = (LEVELS, PAST, LEVELS * PAST)
FLAG_OFFSETS = np.cumsum((0, *FLAG_CONTEXTS))[:-1]
FLAG_ROWS = sum(FLAG_CONTEXTS)
FLAG_WEIGHTS = np.array([0.3, 0.25, 0.25, 0.35], np.float32)
#: Stretched starting probability of a decision: it rises with the logarithm of how often the context was followed;
#: and the decisions that it counts for beside a document's own.
STEEP, LOW, FLAG_PRIOR = 0.3, 2.0, 4.0
FLAG_GATES = 8

WORDS, PAIRS, TRIPLES = 0, 1, 2
_START = U64(0x5851F42D4C957F2D)
_ONE, _TWO = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def symbol(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[:HEAD]) & (SYMBOLS - 1)


def ending(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-TAIL:], 1) & (SYMBOLS - 1)


def word_key(word: bytes) -> int:
    """A word's key: hash bits above its bucket."""
    return xxhash.xxh64_intdigest(word) >> (64 - WORD_BITS + DEPTH) << DEPTH | symbol(word)


def _back(x: np.ndarray, place: np.ndarray, k: int, first) -> np.ndarray:
    """The value k tokens before each token of the same document, else `first`."""
    out = np.full_like(x, first)
    out[k:] = np.where(place[k:] >= k, x[: len(x) - k], first)
    return out


def places(starts: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def contexts(symbols: np.ndarray, endings: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Row of each bucket predictor's table for every token; tokens before a document's start count as symbol 0."""
    n = len(symbols)
    place = places(starts, n)
    one, two = _back(symbols, place, 1, 0), _back(symbols, place, 2, 0)
    both = (mix(one.astype(U64) * U64(SYMBOLS) + two.astype(U64)) & U64(CONTEXTS[2] - 1)).astype(np.int64)
    found = (np.zeros(n, np.int64), one, both, _back(endings, place, 1, 0), two)
    return [(x + o).astype(np.int32) for x, o in zip(found, OFFSETS, strict=True)]


def gram_keys(words: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token with the one before it, and with the two before it, in the upper bits of 64, documents below.

    `words` are the tokens' word keys. The lower DOC_BITS are the number of the token's document.
    """
    n = len(words)
    place = places(starts, n)
    doc = np.repeat(np.arange(len(starts), dtype=U64), np.diff(np.append(starts, n)))
    one, two = _back(words, place, 1, _START), _back(words, place, 2, _START)
    pair = mix(words + one * _ONE)
    cut = U64(64 - bits)
    return pair >> cut << U64(DOC_BITS) | doc, mix(pair + two * _TWO) >> cut << U64(DOC_BITS) | doc


def distinct(keys: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct upper parts of gram keys, and how many occurrences each has in documents to learn from."""
    keys = np.sort(keys)
    use = learns[(keys & U64((1 << DOC_BITS) - 1)).astype(np.int64)]
    keys >>= U64(DOC_BITS)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(use.astype(np.int64), first)


def others(keys: np.ndarray, learns: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of each token, how often its gram occurs in the training texts other than its own; totals as distinct() sorts them."""
    order = np.argsort(keys)
    keys = keys[order]
    own = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(own, len(keys)))
    top = keys[own] >> U64(DOC_BITS)
    at = np.cumsum(np.concatenate(([0], (top[1:] != top[:-1]).astype(np.int64))))
    mine = np.where(learns[(keys[own] & U64((1 << DOC_BITS) - 1)).astype(np.int64)], size, 0)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(totals[at] - mine, size)
    return out


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + zstandard.compress(x.view("u1").reshape(-1, 8)[:, :width].T.tobytes(), LEVEL)


def unpacked(data: bytes, n: int) -> np.ndarray:
    width, out = data[0], np.zeros((n, 8), "u1")
    if width:
        out[:, :width] = np.frombuffer(zstandard.decompress(data[1:]), "u1").reshape(width, n).T
    return out.view("<u8").ravel()


def node_table(counts: np.ndarray) -> np.ndarray:
    """Stretched probabilities that a node's bit is 1, from counts of symbols: one row a context, one column a node."""
    table = np.zeros(counts.shape, np.float32)
    level = counts.astype(np.float32)
    for depth in range(DEPTH - 1, -1, -1):
        zero, one = level[:, 0::2], level[:, 1::2]
        table[:, 1 << depth : 2 << depth] = np.log((one + 0.4) / (zero + 0.4))
        level = zero + one
    return table


class Decision:
    """Whether each token is among those that followed its context in the training texts.

    seen: how often the context was followed; count: how often by the token. No decision is coded where nothing followed.
    """

    def __init__(self, seen: np.ndarray, count: np.ndarray, starts: np.ndarray, hits: np.ndarray):
        self.coded = seen > 0
        self.hit = self.coded & (count > 0)
        self.level = np.minimum(np.log2(np.maximum(seen, 1)), LEVELS - 1).astype(np.int16)
        place = places(starts, len(seen))
        past = sum(_back(hits.astype(np.int16), place, k, 0) << (k - 1) for k in (1, 2, 3))
        self.rows = [self.level, past + np.int16(FLAG_OFFSETS[1]), self.level * np.int16(PAST) + past + np.int16(FLAG_OFFSETS[2])]
        self.gate = np.minimum(self.level, 3) * 2 + (past & 1)
        self.start = (STEEP * np.log(seen + 0.5) - LOW).astype(np.float32)


class Mixer:
    """Codes the decisions and buckets of many documents at once: a block of each document at a time."""

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1)

    def bits(self, symbols: np.ndarray, rows: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, decisions: tuple[Decision, ...] = ()) -> np.ndarray:
        """Bits of each document's decisions and buckets."""
        docs, k, more = len(starts), len(rows) + 1, len(decisions)
        total = np.zeros(docs)
        weights = np.tile(WEIGHTS, (docs, DEPTH * GATES, 1))
        own = np.zeros((docs, SYMBOLS), np.float32)
        hits = np.zeros((docs, 2, BUCKETS), np.float32)
        flag_weights = np.tile(FLAG_WEIGHTS, (docs, more * FLAG_GATES, 1))
        flag_own = np.zeros((docs, 2, more * FLAG_ROWS), np.float32)
        flag_hits = np.zeros((docs, 2, BUCKETS), np.float32)
        live, begin, end = np.arange(docs), 0, FIRST
        while True:
            left = sizes[live] > begin
            if not left.all():
                # What is learned is kept for unfinished documents only, so many short blocks of a few stay cheap.
                live = live[left]
                weights, own, hits, flag_weights, flag_own, flag_hits = (x[left] for x in (weights, own, hits, flag_weights, flag_own, flag_hits))
            if not len(live):
                return total
            size = np.minimum(sizes[live], end) - begin
            first = np.cumsum(size) - size
            at = np.repeat(starts[live] + begin - first, size) + np.arange(size.sum())
            doc, cost = np.repeat(np.arange(len(live)), size), np.zeros(len(at), np.float32)
            scale = self._scale(end - begin)
            going = np.arange(len(at))
            for f, d in enumerate(decisions):
                some = going[d.coded[at[going]]]
                if len(some):
                    cost[some] += self._decide(d, at[some], doc[some], f, more, flag_weights, flag_own, flag_hits, scale)
                going = going[~d.hit[at[going]]]
            if len(going):
                cost[going] += self._buckets(symbols[at[going]], [r[at[going]].astype(np.int64) for r in rows], doc[going], weights, own, hits, k, scale)
            total[live] += np.add.reduceat(cost.astype(np.float64), first)
            begin, end = end, end + min(end, STRIDE)

    @staticmethod
    def _mixed(inputs, chosen, weights, bit, doc, hits, scale) -> np.ndarray:
        """Bits of one decision of many tokens by mixing; weights and refinement learn it."""
        w = weights[chosen]
        x = np.clip(np.einsum("kn,nk->n", inputs, w), -12, 12)
        p = 1 / (1 + np.exp(-x))
        cell = doc * (2 * BUCKETS) + np.clip(x + BUCKETS / 2, 0, BUCKETS - 1).astype(np.int64)
        better = (hits[cell] + TRUST * p) / (hits[cell + BUCKETS] + TRUST)
        final = np.clip(0.5 * (p + better), 1e-6, 1 - 1e-6)
        slope = bit - p
        for i in range(len(inputs)):
            weights[:, i] += LEARN * np.bincount(chosen, slope * inputs[i], len(weights)) / scale
        hits += np.bincount(cell, bit, len(hits)) + np.bincount(cell + BUCKETS, minlength=len(hits))
        return -np.log2(np.where(bit == 1, final, 1 - final))

    def _decide(self, d: Decision, at, doc, f: int, more: int, weights, own, hits, scale) -> np.ndarray:
        bit = d.hit[at].astype(np.float32)
        start = d.start[at]
        inputs = np.empty((len(FLAG_WEIGHTS), len(at)), np.float32)
        inputs[0] = start
        base = 1 / (1 + np.exp(-start))
        places_ = []
        for i, r in enumerate(d.rows):
            cell = doc * (2 * more * FLAG_ROWS) + f * FLAG_ROWS + r[at]
            ones, both = own.reshape(-1)[cell], own.reshape(-1)[cell + more * FLAG_ROWS]
            p = (ones + FLAG_PRIOR * base + 0.02) / (both + FLAG_PRIOR + 0.04)
            inputs[i + 1] = np.log(p / (1 - p))
            places_.append(cell)
        chosen = (doc * more + f) * FLAG_GATES + d.gate[at]
        cost = self._mixed(inputs, chosen, weights.reshape(-1, weights.shape[2]), bit, doc, hits.reshape(-1), scale)
        for cell in places_:
            np.add.at(own.reshape(-1), cell, bit)
            np.add.at(own.reshape(-1), cell + more * FLAG_ROWS, np.float32(1))
        return cost

    def _buckets(self, mine, rows, doc, weights, own, hits, k: int, scale) -> np.ndarray:
        at_rows = [r * SYMBOLS for r in rows]
        row = doc * SYMBOLS
        ones_at, both_at = self._nodes(own)
        cost = np.zeros(len(mine), np.float32)
        for depth in range(DEPTH):
            node = (1 << depth) + (mine >> (DEPTH - depth))
            bit = ((mine >> (DEPTH - 1 - depth)) & 1).astype(np.float32)
            inputs = np.empty((k, len(mine)), np.float32)
            for i, place in enumerate(at_rows):
                np.take(self.table, place + node, out=inputs[i])
            ones, both = ones_at[row + node], both_at[row + node]
            base = 1 / (1 + np.exp(-inputs[0]))
            near = (ones + PRIOR * base + 0.02) / (both + PRIOR + 0.04)
            inputs[-1] = np.log(near / (1 - near))
            gate = (np.abs(inputs[2]) > 1).astype(np.int64) + (both > 8)
            cost += self._mixed(inputs, (doc * DEPTH + depth) * GATES + gate, weights.reshape(-1, k), bit, doc, hits.reshape(-1), scale)
        np.add.at(own.reshape(-1), doc * SYMBOLS + mine, np.float32(1))
        return cost

    @staticmethod
    def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node of each document, how often its bit was 1 and how often it was passed."""
        ones, both, level = np.empty_like(counts), np.empty_like(counts), counts
        for depth in range(DEPTH - 1, -1, -1):
            one = level[:, 1::2]
            level = level[:, 0::2] + one
            ones[:, 1 << depth : 2 << depth], both[:, 1 << depth : 2 << depth] = one, level
        return ones.reshape(-1), both.reshape(-1)

    @staticmethod
    def _scale(size: int) -> float:
        """Gradients of a longer block are sums of more terms."""
        return max(1.0, size / FIRST) ** 0.5


_ROWS = "kind string, place long, chunk long, payload binary, n long, counts binary"
_ROW_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
_ROW_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _ROW_KINDS, strict=True)], _ROW_NAMES)


class _Chunk:
    """Documents of about CHUNK tokens as ids of the chunk's own dictionary."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.docs, self.ids, self.learned, self.n_bytes, self.tokens = [], [], [], [], 0

    def add(self, doc_id, text: bytes, learn: bool) -> None:
        words = words_of(text) + [END]
        at = self.at
        new = set(words).difference(at)
        at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
        self.docs.append(np.fromiter(map(at.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.learned.append(learn)
        self.n_bytes.append(sum(map(len, words)) + len(words) - 1)
        self.tokens += len(words)

    def full(self) -> bool:
        return self.tokens >= CHUNK or len(self.docs) >= 1 << DOC_BITS

    def rows(self, chunk: int, bits: int, shards: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The chunk's texts and, by shard, its distinct keys with their counts; bucket counts are added to `counts`."""
        words = list(self.at)
        keys = np.fromiter(map(word_key, words), U64, len(words))
        endings = np.fromiter(map(ending, words), np.int64, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(keys)
        keys, endings, lengths = keys[order], endings[order], lengths[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes, learns = np.array([len(x) for x in self.docs]), np.array(self.learned, bool)
        seq = place[np.concatenate(self.docs)]
        starts = np.cumsum(sizes) - sizes
        use = np.repeat(learns, sizes)
        mine = (keys & U64(SYMBOLS - 1)).astype(np.int64)[seq]
        chosen = mine[use]
        for r in contexts(mine, endings[seq], starts):
            np.add.at(counts, r[use].astype(np.int64) * SYMBOLS + chosen, 1)
        head = np.array([len(sizes), len(seq), len(keys)], "<i8").tobytes() + np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + np.array([i is None for i in self.ids], "u1").tobytes()
        parts = [head + sizes.astype("<i4").tobytes() + np.array(self.n_bytes, "<i8").tobytes() + learns.astype("u1").tobytes(), packed(seq), packed(np.diff(keys, prepend=U64(0))), packed(endings), packed(lengths)]
        yield _row("texts", chunk, chunk, b"".join(len(x).to_bytes(8, "little") + x for x in parts), len(seq), None)
        known = np.bincount(seq[use], minlength=len(keys))
        pair, triple = gram_keys(keys[seq], starts, bits)
        for kind, width, found in ((WORDS, WORD_BITS, (keys, known)), (PAIRS, bits, distinct(pair, learns)), (TRIPLES, bits, distinct(triple, learns))):
            ends = np.searchsorted(found[0], (np.arange(1, shards, dtype=U64)) << U64(width - int(shards).bit_length() + 1))
            for shard, (a, b) in enumerate(zip([0, *ends], [*ends, len(found[0])], strict=True)):
                if a < b:
                    yield _row(("words", "pairs", "triples")[kind], shard, chunk, packed(np.diff(found[0][a:b], prepend=U64(0))), int(b - a), packed(found[1][a:b]))


def _read(payload: bytes) -> dict[str, np.ndarray]:
    parts, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 8], "little")
        parts.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    docs, tokens, words = np.frombuffer(parts[0], "<i8", 3).tolist()
    out, at = {}, 24
    for name, kind in (("ids", "<i8"), ("null", "u1"), ("sizes", "<i4"), ("bytes", "<i8"), ("learns", "u1")):
        out[name] = np.frombuffer(parts[0], kind, docs, at)
        at += out[name].nbytes
    out |= {"seq": unpacked(parts[1], tokens).astype(np.int64), "keys": np.cumsum(unpacked(parts[2], words), dtype=U64)}
    return out | {"endings": unpacked(parts[3], words).astype(np.int64), "lengths": unpacked(parts[4], words).astype(np.int64), "learns": out["learns"].astype(bool)}


def _answer(rows: pa.Table) -> pa.Table:
    """One shard: every key's count over all chunks, back to each chunk that asked. Texts and tables pass."""
    kind = rows["kind"][0].as_py()
    if kind in ("texts", "tables"):
        return rows
    sizes = rows["n"].to_pylist()
    keys = np.concatenate([np.cumsum(unpacked(x, n), dtype=U64) for x, n in zip(rows["payload"].to_pylist(), sizes, strict=True)])
    counts = np.concatenate([unpacked(x, n) for x, n in zip(rows["counts"].to_pylist(), sizes, strict=True)]).astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    totals = np.add.reduceat(counts, first)
    answers = np.empty(len(keys), np.int64)
    answers[order] = np.repeat(totals, np.diff(np.append(first, len(keys))))
    shard, ends = rows["place"][0].as_py(), np.cumsum(sizes)
    out = [(kind, shard, chunk, packed(answers[e - n : e]), n, None) for chunk, n, e in zip(rows["chunk"].to_pylist(), sizes, ends, strict=True)]
    if kind == "words":
        bucket = (keys[first] & U64(SYMBOLS - 1)).astype(np.int64)
        told = np.stack([np.bincount(bucket, totals, SYMBOLS), np.bincount(bucket, totals > 0, SYMBOLS)]).astype("<i8")
        out.append(("tables", -1, shard, zstandard.compress(told.tobytes(), 1), None, None))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _ROW_KINDS, strict=True)], _ROW_NAMES)


def _chunks(bits: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        counts = np.zeros(ROWS * SYMBOLS, np.int32)
        chunk = _Chunk()
        for batch in pieces(batches):
            for doc_id, text, learn in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                chunk.add(doc_id, text, bool(learn))
                if chunk.full():
                    yield from chunk.rows((task << 32) + number, bits, shards, counts)
                    chunk, number = _Chunk(), number + 1
        if chunk.docs:
            yield from chunk.rows((task << 32) + number, bits, shards, counts)
        step = BLOCK_ROWS * SYMBOLS
        for part in range(0, len(counts), step):
            some = counts[part : part + step]
            if some.any():
                yield _row("tables", part // step, task, zstandard.compress(some.astype("<i8").tobytes(), 1), None, None)

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """The sum of one block's tables."""
    total = sum(np.frombuffer(zstandard.decompress(x), "<i8") for x in rows["payload"].to_pylist())
    return pa.table({"chunk": pa.array([rows["chunk"][0].as_py() // FAN_IN], pa.int64()), "place": pa.array([rows["place"][0].as_py()], pa.int64()), "payload": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})


def _tables(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts by context, and by bucket the training tokens and distinct ones: tables of fixed size, summed in steps."""
    tables = rows.where("kind = 'tables'").select("chunk", "place", "payload", F.expr(f"chunk div {FAN_IN}").alias("group"))
    while True:
        tables = stored(tables.groupBy("place", "group").applyInArrow(_summed, "chunk long, place long, payload binary"), "tables").withColumn("group", F.expr(f"chunk div {FAN_IN}"))
        if not tables.where("chunk > 0").take(1):
            break
    counts, told = np.zeros((ROWS, SYMBOLS), np.int64), np.zeros((2, SYMBOLS), np.int64)
    for part, payload in tables.select("place", "payload").toLocalIterator():
        block = np.frombuffer(zstandard.decompress(bytes(payload)), "<i8").reshape(-1, SYMBOLS)
        if part < 0:
            told = block
        else:
            counts[part * BLOCK_ROWS : part * BLOCK_ROWS + len(block)] = block
    return counts, told


_SCORES = "doc_id long, learned boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows where the condition `learn` holds. base_score is the add-one unigram log10 probability,
    score the mixing model's over the same tokens. n_bytes are the words' bytes with one separator each, which is all
    that is coded; bits_per_byte are the bits of score and, for unseen words, 8 a byte of their spelling, divided by
    n_bytes, and null for a text without words. A null text is empty and has the end token alone; null doc_ids and
    repeated rows are scored (and learned from) like others; a null condition is false. Other columns are not read.
    Ids are integers, else a TypeError.
    """
    spark = docs.sparkSession
    rows = docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, size) / SHARD_BYTES)))
    bits = min(MOST_BITS, max(32, size.bit_length() + SPARE_BITS - 2))
    made = rows.mapInArrow(_chunks(bits, shards), _ROWS)
    made = stored(made.groupBy("kind", "place").applyInArrow(_answer, _ROWS), "counts", **WRITTEN, **{"parquet.block.size": GROUP_BYTES})
    counts, told = _tables(made)
    n, v = (int(x) for x in told.sum(1))
    shared = spark.sparkContext.broadcast((node_table(counts).astype(np.float16), np.log10(told.sum(0) + 1.0)))

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        x = _read(texts["payload"][0].as_py())
        by = {}
        for kind, _, data, m in sorted(zip(*(answers[c].to_pylist() for c in ("told", "shard", "answer", "keys")), strict=True)):
            by.setdefault(kind, []).append(unpacked(data, m))
        by = {k: np.concatenate(parts).astype(np.int64) for k, parts in by.items()}
        return _scored(x, by, bits, n, v, *shared.value)

    # Texts and answers of one chunk meet; the rest of `made` are tables.
    texts, answers = made.where("kind = 'texts'").select("chunk", "payload"), made.where("kind in ('words', 'pairs', 'triples')").select(F.col("chunk").alias("of"), F.col("kind").alias("told"), F.col("place").alias("shard"), F.col("payload").alias("answer"), F.col("n").alias("keys"))
    return texts.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, _SCORES)


def _told(x: dict, by: dict, bits: int, share: np.ndarray) -> tuple:
    """What scoring needs of every token, from the answers to a chunk; the token arrays between end here.

    The decisions, bucket, contexts, log10 of what a word costs in its bucket or what followed, log10 of its count with
    one more, whether it is known, and the bits of an unseen word's spelling.
    """
    sizes, seq, learns = x["sizes"].astype(np.int64), x.pop("seq"), x["learns"]
    starts = np.cumsum(sizes) - sizes
    pair, triple = gram_keys(x["keys"][seq], starts, bits)
    pair = others(pair, learns, by.pop("pairs"))
    triple = others(triple, learns, by.pop("triples"))
    c = by.pop("words")[seq]
    # How often each context was followed in the other texts: of the first token, their number.
    place, texts = places(starts, len(seq)), c[starts + sizes - 1] - learns
    seen_one, seen_two = _back(c, place, 1, 0), _back(pair, place, 1, 0)
    seen_one[starts] = seen_two[starts] = texts
    del place
    # Keys are hashes, so what follows may seem to occur more often than its context.
    np.minimum(triple, seen_two, out=triple)
    np.minimum(pair, seen_one, out=pair)
    decisions = (Decision(seen_two, triple, starts, triple > 0), Decision(seen_one, pair, starts, pair > 0))
    mine, logs = (x["keys"] & U64(SYMBOLS - 1)).astype(np.int64)[seq], np.log10(c + 1.0)
    inner = np.where(decisions[0].hit, np.log10(np.maximum(triple, 1) / np.maximum(seen_two, 1)), np.where(decisions[1].hit, np.log10(np.maximum(pair, 1) / np.maximum(seen_one, 1)), logs - share[mine]))
    del pair, triple, seen_one, seen_two
    known = c > 0
    del c
    spelled = np.where(known, 0, 8 * x["lengths"][seq])
    return decisions, mine, contexts(mine, x["endings"][seq], starts), inner, logs, known, spelled


def _scored(x: dict, by: dict, bits: int, n: int, v: int, table: np.ndarray, share: np.ndarray) -> pa.Table:
    """The scores of a chunk. `x` and `by` are used up: their token arrays are let go on the way."""
    names = [c.split()[0] for c in _SCORES.split(", ")]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    out: list[list] = [[] for _ in names]
    sizes, learns = x["sizes"].astype(np.int64), x["learns"]
    starts = np.cumsum(sizes) - sizes
    decisions, mine, rows, inner, logs, known, spelled = _told(x, by, bits, share)
    mixer = Mixer(table.astype(np.float32))
    # Slices of a bounded number of documents and tokens.
    a = 0
    while a < len(sizes):
        b = a + max(1, min(2048, int(np.searchsorted(starts[a:] + sizes[a:], starts[a] + (1 << 19), "right"))))
        begin, size = starts[a:b], sizes[a:b]
        told = mixer.bits(mine, rows, begin, size, decisions)
        add = lambda z: np.add.reduceat(z[begin[0] : begin[-1] + size[-1]], begin - begin[0])
        score = add(inner) - told * np.log10(2)
        base = add(logs) - size * np.log10(n + v + 1)
        n_bytes = x["bytes"][a:b]
        per_byte = [(-s / np.log10(2) + e) / m if m else None for s, e, m in zip(score, add(spelled), n_bytes, strict=True)]
        ids = [None if none else int(i) for i, none in zip(x["ids"][a:b], x["null"][a:b], strict=True)]
        for column, values in zip(out, (ids, learns[a:b], n_bytes, size, add(known.astype(np.int64)), [n] * (b - a), base, score, per_byte), strict=True):
            column += list(values)
        a = b
    return pa.table([pa.array(y, k) for y, k in zip(out, kinds, strict=True)], names)

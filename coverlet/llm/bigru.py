"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes (A-Z lower-cased, white space as single spaces) are read in windows that run across words. Two GRUs read
a window from both ends; from both states every byte position gets a label distribution. Windows overlap by MARGIN
bytes on each side, which give context and are labelled by the neighbouring window, so that every position of a whole
text is labelled once. A document's log-probabilities are the mean over all its positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, pieces, texts_of, words_of

HIDDEN = 16
#: Bytes of a window that are labelled, and those on each side of them that are context only.
CORE, MARGIN = 112, 8
#: Windows that are read together.
TOGETHER = 512
#: Bounds of the training sample: labelled documents, and bytes of their whole texts.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 6 << 20
#: Bytes of a training window, windows of a batch, least number of batches, and the learning rate.
SPAN, BATCH, STEPS, RATE = 64, 256, 300, 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def stream(text: bytes) -> bytes:
    """What the network reads of a text."""
    return b" ".join(words_of(text))


def windows(data: list[bytes], core: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts, where each window begins, its labelled positions, windows of each text); outside a text are spaces."""
    sizes = np.array([len(x) for x in data], np.int64)
    count = -(-sizes // core)
    flat = np.frombuffer(b"".join(b" " * margin + x + b" " * (n * core - len(x) + margin) for x, n in zip(data, count.tolist(), strict=True)), np.uint8)
    spans = count * core + 2 * margin
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(spans) - spans, count) + number * core
    live = np.minimum(np.repeat(sizes, count) - number * core, core)
    return flat, begin, live, count


def _gates(a: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    a *= np.float32(0.5)
    np.tanh(a, out=a)
    a *= np.float32(0.5)
    a += np.float32(0.5)
    return a


@dataclass
class BiGRU:
    """weights, both directions first: W (2 x bytes x 3H), U (2 x H x 2H), V (2 x H x H), b (2 x 3H), O (2 x H x L); c (L)."""

    labels: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> BiGRU:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        w = {"W": draw(2, 256, 3 * hidden), "U": draw(2, hidden, 2 * hidden), "V": draw(2, hidden, hidden), "b": np.zeros((2, 3 * hidden), np.float32)}
        return cls(labels, w | {"O": draw(2, hidden, len(labels)), "c": np.zeros(len(labels), np.float32)})

    def read(self, grid: np.ndarray, saved: list | None = None) -> np.ndarray:
        """States (position, direction, window, H) after each byte in reading order; `saved` gets what backpropagation needs."""
        w, (T, n) = self.weights, grid.shape
        H, kind = w["V"].shape[1], w["W"].dtype
        table = w["W"] + w["b"][:, None]
        states, h = np.empty((T, 2, n, H), kind), np.zeros((2, n, H), kind)
        x, a, c, rh = np.empty((2, n, 3 * H), kind), np.empty((2, n, 2 * H), kind), np.empty((2, n, H), kind), np.empty((2, n, H), kind)
        for t in range(T):
            np.take(table[0], grid[t], 0, out=x[0], mode="clip")
            np.take(table[1], grid[T - 1 - t], 0, out=x[1], mode="clip")
            np.matmul(h, w["U"], out=a)
            a += x[..., : 2 * H]
            _gates(a)
            np.multiply(a[..., H:], h, out=rh)
            np.matmul(rh, w["V"], out=c)
            c += x[..., 2 * H :]
            np.tanh(c, out=c)
            if saved is not None:
                saved.append((h.copy(), a.copy(), c.copy()))
            c -= h
            c *= a[..., :H]
            h += c
            states[t] = h
        return states

    def log_probs(self, states: np.ndarray, margin: int = 0) -> np.ndarray:
        """Label log-probabilities (label, position, window) of the positions that are not margin."""
        w, (T, _, n, H) = self.weights, states.shape
        forth, back = states[margin : T - margin, 0].reshape(-1, H), states[::-1][margin : T - margin, 1].reshape(-1, H)
        y = np.ascontiguousarray((forth @ w["O"][0] + back @ w["O"][1] + w["c"]).T)
        y -= y.max(0)
        y -= np.log(np.exp(y).sum(0))
        return y.reshape(len(self.labels), T - 2 * margin, n)

    def sums(self, grid: np.ndarray, live: np.ndarray, margin: int) -> np.ndarray:
        """Of each window the sums of label log-probabilities over its labelled positions."""
        y = self.log_probs(self.read(grid), margin)
        on = (np.arange(y.shape[1])[:, None] < live).astype(y.dtype)
        return np.einsum("ltn,tn->nl", y, on)

    def gradients(self, grid: np.ndarray, live: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the first `live` positions of each window and its gradients, by backpropagation through time."""
        w, (T, n), saved = self.weights, grid.shape, []
        H = w["V"].shape[1]
        states = self.read(grid, saved)
        y = self.log_probs(states)
        on = np.arange(T)[:, None] < live
        places = np.arange(n)
        loss = -(y[target, :, places].T * on).sum() / on.sum()
        p = np.exp(y)
        p[target, :, places] -= 1
        p = (p * (on / on.sum()).astype(p.dtype)).transpose(1, 2, 0)
        back = states[::-1, 1]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["O"][0], g["O"][1], g["c"] = np.einsum("tnh,tnl->hl", states[:, 0], p), np.einsum("tnh,tnl->hl", back, p), p.sum((0, 1))
        gh = np.zeros((2, n, H), p.dtype)
        for t in range(T - 1, -1, -1):
            h, a, c = saved[t]
            z, r = a[..., :H], a[..., H:]
            gh[0] += p[t] @ w["O"][0].T
            gh[1] += p[T - 1 - t] @ w["O"][1].T
            gc = gh * z * (1 - c * c)
            grh = gc @ w["V"].transpose(0, 2, 1)
            gates = np.concatenate([gh * (c - h) * z * (1 - z), grh * h * r * (1 - r)], 2)
            g["U"] += h.transpose(0, 2, 1) @ gates
            g["V"] += (r * h).transpose(0, 2, 1) @ gc
            both = np.concatenate([gates, gc], 2)
            np.add.at(g["W"][0], grid[t], both[0])
            np.add.at(g["W"][1], grid[T - 1 - t], both[1])
            gh = gh * (1 - z) + grh * r + gates @ w["U"].transpose(0, 2, 1)
        g["b"] = g["W"].sum(1)
        return float(loss), g


def train(texts: list[bytes], target: np.ndarray, labels: list[str], least: int = STEPS, seed: int = 7) -> BiGRU:
    """Adam on batches of the texts' windows, in random order until each was read once, and again up to `least` batches.

    The same input gives the same network.
    """
    net, rng = BiGRU.new(labels, seed=seed), np.random.default_rng(seed)
    flat, begin, live, count = windows(texts, SPAN, 0)
    across = np.arange(SPAN)[:, None]
    target = np.repeat(target, count)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    steps = max(least, -(-len(live) // BATCH))
    queue = np.concatenate([rng.permutation(len(live)) for _ in range(-(-steps * BATCH // len(live)))])
    for step in range(1, steps + 1):
        pick = queue[(step - 1) * BATCH : step * BATCH]
        _, g = net.gradients(flat[begin[pick] + across], live[pick], target[pick])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.001 * (x * x - v[k])
            net.weights[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: BiGRU, texts: list[bytes]) -> list[tuple[str, float]]:
    """The likeliest label of each text and its probability; UNKNOWN and 0 for a text without a letter."""
    data = [stream(x) for x in texts]
    sums = np.zeros((len(texts), len(net.labels)))
    flat, begin, live, count = windows(data, CORE, MARGIN)
    across = np.arange(CORE + 2 * MARGIN)[:, None]
    of = np.repeat(np.arange(len(texts)), count)
    for start in range(0, len(live), TOGETHER):
        some = slice(start, start + TOGETHER)
        np.add.at(sums, of[some], net.sums(flat[begin[some] + across], live[some], MARGIN))
    out = []
    for text, x, y in zip(texts, data, sums, strict=True):
        if not x or not _LETTER.search(text.decode("utf-8", "replace")):
            out.append((UNKNOWN, 0.0))
            continue
        y = y / len(x)
        p = np.exp(y - y.max())
        out.append((net.labels[int(p.argmax())], float(p.max() / p.sum())))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out=None) -> BiGRU | None:
    """A network learned from whole texts of labelled documents: those of the least id hash, at most SAMPLE_DOCS of them
    and as many as fit in SAMPLE_BYTES (but one at least).

    Rows with a null text or label, and those where the condition `held_out` holds, are not used; null or repeated ids
    are told apart by their text's hash and count one each. Without any labelled row that has a word there is no network.
    """
    seen = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    if held_out is not None:
        seen = seen.where(~F.coalesce(held_out, F.lit(False)))
    seen = seen.select(F.xxhash64(integral(docs, id_col)).alias("rank"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    first = seen.select("rank", "tie", F.octet_length("text").alias("n")).orderBy("rank", "tie").limit(SAMPLE_DOCS).collect()
    if not first:
        return None
    take = max(1, int(np.searchsorted(np.cumsum([r.n for r in first]), SAMPLE_BYTES, "right")))
    rows = seen.where(F.col("rank") <= first[take - 1].rank).orderBy("rank", "tie", "label").limit(take).collect()
    told = [(stream(r.text.encode()), r.label) for r in rows]
    told = [x for x in told if x[0]]
    labels = sorted({x[1] for x in told})
    return train([x[0] for x in told], np.array([labels.index(x[1]) for x in told]), labels) if told else None


def label_languages(docs: DataFrame, net: BiGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score (0 to 1). Only the text decides.

    UNKNOWN with score 0 for a null text, one without a letter, and where there is no network. Repeated rows and
    null doc_ids are labelled like others. Ids are integers, else a TypeError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch.column(1))
            found = pooled(net, texts) if net else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, net: BiGRU | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The documents whose language is recognised with a probability of at least `least`; columns stay as they are.

    Null texts and those without a letter go. Without a network no language is known, so none is rejected: only those
    texts go. Repeated rows are treated alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            if net:
                keep = [x[0] != UNKNOWN and x[1] >= least for x in pooled(net, texts)]
            else:
                keep = [bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

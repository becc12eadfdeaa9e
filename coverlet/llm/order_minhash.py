"""Document fingerprints by Order MinHash (Marcais et al., 2019), which are sensitive to edit distance.

Each of the COUNT hash functions selects the LENGTH least among a text's occurrence-numbered k-mers of code
points, puts them back in text order, and hashes that tuple. Likeness is the share of equal tuples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, integral, mix, pieces, shuffle_parts, texts_of

COUNT, LENGTH, KMER = 48, 2, 8
_ODD = mix(np.arange(1, 200, dtype=U64)) | U64(1)
_SEED = mix(np.arange(1000, 1199, dtype=U64))


def sketch(text: str, count: int = COUNT, length: int = LENGTH, k: int = KMER) -> np.ndarray:
    """`count` unsigned 32-bit values. A text shorter than k is one k-mer; the empty text has none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    if not len(code):
        return np.zeros(count, np.uint32)
    h, width = mix(code + U64(1)), 1
    k = min(k, len(code))
    while width < k:
        step = min(width, k - width)
        h = h[: len(h) - step] * _ODD[0] + (h[step:] ^ (h[step:] >> U64(31)))
        width += step
    h = (h ^ (h >> U64(32))) * _ODD[1]
    n = len(h)
    bits = U64(max(1, n.bit_length()))
    at = np.sort((h >> bits << bits) | np.arange(n, dtype=U64))
    position = (at & ((U64(1) << bits) - U64(1))).astype(np.int64)
    kmer = at >> bits
    first = np.flatnonzero(np.concatenate(([True], kmer[1:] != kmer[:-1])))
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    key = h[position] + number.astype(U64) * _ODD[2]
    key ^= key >> U64(29)
    short = (key * _ODD[151] >> U64(32)).astype(np.uint32)
    out = np.empty((count, min(length, n)), np.int64)
    for i in range(count):
        x = (short ^ _SEED[i].astype(np.uint32)) * _ODD[3 + i].astype(np.uint32)
        for j in range(out.shape[1]):
            out[i, j] = best = x.argmin()
            x[best] = np.uint32(0xFFFFFFFF)
    order = np.argsort(position[out], axis=1)
    out = np.take_along_axis(out, order, 1)
    value = mix(np.arange(1, count + 1, dtype=U64))
    for j in range(out.shape[1]):
        value = mix(value ^ key[out[:, j]]) * _ODD[150]
    return (value >> U64(32)).astype(np.uint32)


def fingerprint(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, other: str) -> str:
    """The last half of a text, rounded down, replaced by as much of the other text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: doc_id, n_chars, fingerprint. A null text is empty; repeated rows have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [x.decode("utf-8", "replace") for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([fingerprint(sketch(x)) for x in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document's, in order of doc_id.

    Rows of one doc_id follow each other in order of their text; null doc_ids come first. A null text is empty.
    Ranges of doc_id are dealt to the tasks together with the one row that follows each range, so texts are
    shuffled once and no task sees more than its range. Other columns are not read. Ids are integers, else a TypeError.
    """
    least = -(1 << 63)
    docs = docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    n = shuffle_parts(docs.sparkSession)
    found = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, [(k + 1) / n for k in range(n - 1)] or [0.5], F.lit(max(10_000, 10 * n))).alias("at")).first()
    first = found.least if found.least is not None else 0
    starts = sorted({x for x in found["at"] or [] if x > first})
    rank = _rank(key, starts)
    begins = F.when(rank > 0, F.get(F.lit(starts) if starts else F.array(F.lit(0).cast("long")), rank - 1) == key)
    to = F.array(F.struct(rank.alias("part"), F.lit(0).alias("ahead")))
    to = F.when(begins, F.array_append(to, F.struct((rank - 1).alias("part"), F.lit(1).alias("ahead")))).otherwise(to)
    to = F.when(key == first, F.array_append(to, F.struct(F.lit(len(starts)).alias("part"), F.lit(1).alias("ahead")))).otherwise(to)
    dealt = docs.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.part", "to.ahead")
    dealt = dealt.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done = None, False
        for batch in pieces(batches):
            out = []
            for doc_id, text, ahead in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                if done:
                    break
                text = text.decode("utf-8", "replace")
                mark = sketch(text)
                if waiting:
                    edited = edit(waiting[1], text)
                    changed = sketch(edited)
                    out.append((waiting[0], len(waiting[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(waiting[2]), fingerprint(changed), likeness(waiting[2], changed), likeness(waiting[2], mark)))
                waiting, done = (doc_id, text, mark), bool(ahead)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return dealt.mapInArrow(run, schema)


def _rank(key, starts: list[int]):
    """How many of the sorted `starts` are at most `key`, found in two steps of about sqrt(len(starts)) comparisons."""
    if not starts:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[k : k + step] for k in range(0, len(starts), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    group = upto(F.lit([g[0] for g in groups]))
    within = upto(F.get(F.array(*[F.lit(g) for g in groups]), group - 1))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within).cast("int")

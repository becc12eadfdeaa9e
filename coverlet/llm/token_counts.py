"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch's rows are signed: inserts add a document and its tokens, deletes take them away, revised counts add the
difference. Totals are sums, so a batch is aggregated alone and added to the last totals; the new totals and the
batch's name become visible together as the manifest's next version. A batch that is committed again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, texts_of
from .manifest import Manifest
from .tokens import ByteEncoder, ChunkEncoder

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of new documents: rows (source, lang, tokenizer_version, tokens); a null count is 0."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Deltas of revised counts: rows with `was` beside `tokens`."""
    change = F.coalesce("tokens", F.lit(0)) - F.coalesce("was", F.lit(0))
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), change.cast("long").alias("tokens"))


def token_counts(docs: DataFrame, word_tokenizer: str, byte_ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows (source, lang) with each text's ids by two tokenizers: word_tokens and byte_tokens.

    `word_tokenizer` is the path of a lower-casing word tokenizer, `byte_ranks` that of a byte vocabulary's ranks, which
    splits by `pattern`. A null text has no ids; repeated rows are counted each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = ChunkEncoder.at(word_tokenizer, 250_000), ByteEncoder.at(byte_ranks, pattern)
        for batch in pieces(batches, limit=4 << 20):
            texts = texts_of(batch.column(2))
            counts = ([len(x) // 4 for x in words.encode(texts)], [parts.count(x) for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)], ["source", "lang", "word_tokens", "byte_tokens"])

    named = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "source string, lang string, word_tokens long, byte_tokens long")


class TokenTotals:
    """Totals below `root`, a folder that all executors share. Null sources, languages and versions are keys."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, root)

    def read(self, version: int | None = None) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) of a version; empty before the first batch."""
        _, content = self.manifest.read(version)
        return self.spark.read.schema(TOTALS).parquet(content["path"]) if content else self.spark.createDataFrame([], TOTALS)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch's deltas once; False where a batch of that name is in the totals already.

        Deltas are rows (KEYS, docs, tokens) as inserts, deletes and revisions make them; repeated rows count each time,
        a null key is a key of its own. A batch without rows changes no total and is committed all the same.
        """
        version, content = self.manifest.read()
        if batch in content.get("batches", []):
            return False
        change = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        path = f"{self.root}/totals-{uuid.uuid4().hex}"
        both = self.read(version or None).unionByName(change) if content else change
        both.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens")).write.parquet(path)
        self.manifest.commit(version + 1, {"path": path, "batches": [*content.get("batches", []), batch]})
        return True

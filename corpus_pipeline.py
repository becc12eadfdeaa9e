"""From raw documents to packed sequences, in stages that each work on all that the one before kept.

Languages that are not recognised go, one document of each near-duplicate group stays, documents that contain a
benchmark item go, live secrets are masked, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlet.llm import bigru
from coverlet.llm.common import settle, stored, table
from coverlet.llm.decontaminate import without_contaminated
from coverlet.llm.near_dedup import deduplicated
from coverlet.llm.packing import pack
from coverlet.llm.queries import LIMITS, LOSS_SHARE, TOKENIZER
from coverlet.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return bigru.keep_recognised(docs, bigru.fit(docs, held_out=held_out))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    # The stages before have filled the executors' heaps, so workers remember less.
    return pack(docs, TOKENIZER, limits=LIMITS, loss_share=LOSS_SHARE, remembered=250_000)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: SQL cannot express a trained network, masking and packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

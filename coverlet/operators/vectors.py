"""Embeddings: providers, the table that caches them, similarity search, and places found by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scoring import dot, rescale_semantic

#: Takes texts, returns one float vector each.
Encoder = Callable[[list[str]], np.ndarray]
#: Texts whose words are held at one time.
TEXTS_AT_ONCE = 256


class HashingEncoder:
    """An offline stand-in for a trained model: signed token counts in a fixed number of places, of length 1.

    Its similarities are not on a trained model's scale: thresholds must be calibrated for it.
    """

    name = "hashing-v1"

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.size), np.float32)
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            words = [t.lower().split() for t in texts[start : start + TEXTS_AT_ONCE]]
            h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64)
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            place = row * self.size + (h % np.uint64(self.size)).astype(np.int64)
            counts = np.bincount(place, np.where(h >> np.uint64(63), 1.0, -1.0), len(words) * self.size)
            out[start : start + len(words)] = counts.reshape(-1, self.size)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def encode(rows: DataFrame, encoder: Encoder | None = None, text: str = "text", out: str = "embedding", prefix: str = "") -> DataFrame:
    """The rows with a vector of their text, encoded by the batch; queries take a prefix, passages none."""
    encoder = encoder or HashingEncoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encoder([prefix + (t or "") for t in batch[text]])
            yield batch.assign(**{out: list(vectors)})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{names}, `{out}` array<float>")


def encoder_works(encoder: Encoder, related: tuple[str, str], unrelated: tuple[str, str]) -> bool:
    """Whether a related pair is more similar than an unrelated one."""
    near, far = (float(np.dot(*encoder(list(pair)))) for pair in (related, unrelated))
    return near > far


def text_hash(c):
    return F.sha2(c, 256)


def cache_misses(subchunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The windows whose text has no vector of this model in the cache (model, text_hash, embedding)."""
    wanted = subchunks.withColumn("text_hash", text_hash(F.col("text")))
    return wanted.join(cache.where(F.col("model") == model).select("text_hash").distinct(), "text_hash", "left_anti")


def embed_with_cache(subchunks: DataFrame, cache: DataFrame, encoder: Encoder | None = None, model: str = HashingEncoder.name) -> tuple[DataFrame, DataFrame]:
    """(the windows with vectors, rows to add to the cache): only distinct unknown texts are encoded."""
    fresh = encode(cache_misses(subchunks, cache, model).select("text_hash", "text").dropDuplicates(["text_hash"]), encoder).select(F.lit(model).alias("model"), "text_hash", "embedding")
    # Runs at the same time may have added the same text twice.
    known = cache.where(F.col("model") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"]).unionByName(fresh.select("text_hash", "embedding"))
    return subchunks.withColumn("text_hash", text_hash(F.col("text"))).join(known, "text_hash"), fresh


CACHE = "model string, text_hash string, embedding array<float>"


def encode_cached(subchunks: DataFrame, folder: str, encoder: Encoder | None = None) -> DataFrame:
    """The windows (text, ...) with `embedding`, from the table of vectors kept in the folder; unknown texts are encoded
    once each and appended to it before this returns.

    A vector belongs to a model's name and a text, so a changed book only costs its changed windows. Null texts are
    empty. Lost executors repeat the append's tasks; it commits as a whole.
    """
    spark, encoder = subchunks.sparkSession, encoder or HashingEncoder()
    model = getattr(encoder, "name", type(encoder).__name__)
    subchunks = subchunks.withColumn("text", F.coalesce("text", F.lit("")))
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    cache = spark.read.schema(CACHE).parquet(folder) if there else spark.createDataFrame([], CACHE)
    embed_with_cache(subchunks, cache, encoder, model)[1].write.mode("append").parquet(folder)
    known = spark.read.schema(CACHE).parquet(folder).where(F.col("model") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return subchunks.withColumn("text_hash", text_hash(F.col("text"))).join(known, "text_hash").drop("text_hash")


def similarities(queries: DataFrame, vectors: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Raw similarity of each query (query_embedding) with each vector (embedding), within equal keys `on`.

    Without keys every query meets every vector: the queries are the stated small side.
    """
    pairs = queries.join(vectors, on) if on else vectors.crossJoin(F.broadcast(queries))
    return pairs.withColumn("similarity", dot(F.col("embedding"), F.col("query_embedding"))).drop("embedding", "query_embedding")


def best_per_chunk(pairs: DataFrame, *keys: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Each group's best raw similarity, and that rescaled."""
    best = pairs.groupBy(*keys).agg(F.max("similarity").alias("similarity"))
    return best.withColumn("semantic", rescale_semantic(F.col("similarity"), config))


def top_k(pairs: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k most similar items of each query, ties by item."""
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), item)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibration(pairs: DataFrame, *topic: str) -> DataFrame:
    """One row: percentiles of the topics' best raw similarities (negative ones dropped), extremes, count, and the
    similarity range that the 10th and 90th suggest."""
    best = pairs.groupBy(*topic).agg(F.max("similarity").alias("best")).where("best >= 0")
    shares = (5, 10, 25, 50, 75, 90, 95)
    row = best.agg(F.percentile("best", F.lit([s / 100 for s in shares])).alias("p"), F.min("best").alias("least"), F.max("best").alias("most"), F.count("*").alias("n"))
    return row.select(*(F.col("p")[k].alias(f"p{s}") for k, s in enumerate(shares)), "least", "most", "n", F.col("p")[1].alias("floor"), F.col("p")[5].alias("ceiling"))


def locate_by_content(windows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_key, page_start, page_end, score): the stretch of windows about each document's best one.

    windows: (doc_key, w, page_start, page_end, words, similarity). Windows of too few words count -1; the best is the
    first of equals, and neighbours join while they are within a slack of it. Documents without an eligible window
    give no row.
    """
    rows = windows.withColumn("score", F.when(F.col("words") >= config.locator_words, F.col("similarity")).otherwise(-1.0))
    best = rows.where(F.col("words") >= config.locator_words).groupBy("doc_key").agg(F.max(F.struct("score", (-F.col("w")).alias("o"))).alias("b")).select("doc_key", F.col("b.score").alias("best"), (-F.col("b.o")).alias("at"))
    rows = rows.join(best, "doc_key").withColumn("low", F.col("score") < F.col("best") - config.locator_slack)
    rows = rows.withColumn("island", F.sum(F.col("low").cast("int")).over(Window.partitionBy("doc_key").orderBy("w")))
    mine = rows.where("w = at").select("doc_key", F.col("island").alias("mine"))
    kept = rows.join(mine, "doc_key").where("island = mine and not low")
    return kept.groupBy("doc_key").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.first("best").alias("score"))

"""Shared helpers of the training-data operators: words, hashes, batching, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Bytes of text that a Python worker holds as words at one time.
WORK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
#: Hashes that a worker may hold before they are forgotten; they are cheap to make again.
HASH_ENTRIES = 50_000

U64 = np.uint64


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered up to HASH_ENTRIES words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator, element-wise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def integral(docs: DataFrame, id_col: str) -> Column:
    """A column of integer ids as long; a TypeError for ids of another type, which would not survive the cast."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"ids must be integers: {id_col} is {kind.simpleString()}; number the rows first")
    return F.col(id_col).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    # A worker lives on between tasks: what Arrow holds for it is given back.
    pa.default_memory_pool().release_unused()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share.

    Where the setting is absent a folder below /tmp/checkpoints is set first on a local master; on others that is
    an error.
    """
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(spark: SparkSession) -> SparkSession:
    """Bound what passes between the JVM and a Python worker at once: both sides hold a batch or two."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context._conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, fewer: int = 1, **options) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    A table that is much smaller than the shuffles it comes from is dealt again, after the work, to that many times
    fewer files. `options` are the writer's.
    """
    spark = settle(df.sparkSession)
    path = shared_folder(spark, name)
    if fewer > 1:
        df = df.repartition(max(1, shuffle_parts(spark) // fewer))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written by this run."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")

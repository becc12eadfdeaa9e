"""Tables between the stages of a run, in storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written below spark.checkpoint.dir (below /tmp/checkpoints where it is unset) and read back.

    What follows starts from files: it does not run again what came before, nor carry its expressions.
    """
    spark = df.sparkSession
    root = spark.sparkContext._conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

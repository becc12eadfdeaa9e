"""Shards of a growing data set by size-tiered compaction. DataFrame operations only.

Arrivals become small immutable Parquet shards. Compaction takes runs of similar size (one tier: sizes within a
factor of TIER), merges as many as fill a target-sized file, and commits the outcome as the manifest's next version.
Readers see whole versions only. Merging shuffles nothing: each new file is one task that reads its runs in turn.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifest import Manifest

TARGET_BYTES = 64 << 20
#: Rows of a shard at most, as it arrives.
ARRIVAL_ROWS = 2000
TIER, LEAST_RUNS = 4, 4
#: New files that one merging job writes at most.
FILES_A_JOB = 64
#: Shards up to which the manifest is broadcast when rows are joined with it.
BROADCAST_SHARDS = 100_000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int

    @property
    def tier(self) -> int:
        """Shards whose sizes have the same whole logarithm are similar."""
        return int(math.log(max(1, self.bytes), TIER))


def plan(shards: list[Shard], target: int = TARGET_BYTES, least_runs: int = LEAST_RUNS) -> list[list[Shard]]:
    """Groups of shards to merge, within tiers from the smallest up, none above about the target.

    A group leaves when it fills the target or has `least_runs` runs; shards of at least half the target stay.
    """
    groups, tiers = [], {}
    for s in shards:
        if s.bytes < target // 2:
            tiers.setdefault(s.tier, []).append(s)
    for tier in sorted(tiers):
        group: list[Shard] = []
        for s in sorted(tiers[tier], key=lambda s: (s.bytes, s.path)):
            if group and sum(x.bytes for x in group) + s.bytes > target:
                groups.append(group)
                group = []
            group.append(s)
        if len(group) >= least_runs or sum(x.bytes for x in group) >= target // 2 and len(group) > 1:
            groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """Shards of one data set below `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, root)

    def shards(self, version: int | None = None) -> tuple[int, list[Shard]]:
        version, content = self.manifest.read(version)
        return version, [Shard(**s) for s in content.get("shards", [])]

    def _described(self, folder: str, schema: StructType) -> list[Shard]:
        """The files with rows of a folder that was just written."""
        rows = self.spark.read.schema(schema).parquet(folder).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").count()
        return [Shard(*r) for r in sorted(rows.collect())]

    def append(self, rows: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Write an arrival as shards of at most `shard_rows` rows; each task writes what it reads. The new version.

        Rows are kept as they are: nulls, empty and repeated rows too. An empty frame adds a version without shards of its
        own. All arrivals have the columns of the first; other columns are an error.
        """
        version, old = self.shards()
        if version and self.schema().simpleString() != rows.schema.simpleString():
            raise ValueError(f"an arrival has the columns {rows.schema.simpleString()}, the shards {self.schema().simpleString()}")
        folder = f"{self.root}/arrival-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(folder)
        return self.manifest.commit(version + 1, {"shards": [asdict(s) for s in old + self._described(folder, rows.schema)], "schema": rows.schema.json()})

    def compact(self, target: int = TARGET_BYTES, least_runs: int = LEAST_RUNS) -> int:
        """Merge until no tier has runs to merge; the latest version. No row is lost or changed: counts are compared before a commit."""
        while True:
            version, shards = self.shards()
            groups = plan(shards, target, least_runs)
            if not groups:
                return version
            schema = self.schema()
            made: list[Shard] = []
            for start in range(0, len(groups), FILES_A_JOB):
                some = groups[start : start + FILES_A_JOB]
                folder = f"{self.root}/run-{uuid.uuid4().hex}"
                merged = [self.spark.read.schema(schema).parquet(*(s.path for s in g)).coalesce(1) for g in some]
                reduce(DataFrame.union, merged).write.parquet(folder)
                made += self._described(folder, schema)
            gone = {s.path for g in groups for s in g}
            if sum(s.rows for s in made) != sum(s.rows for g in groups for s in g):
                raise RuntimeError("a merge changed the number of rows")
            kept = [s for s in shards if s.path not in gone]
            _, content = self.manifest.read(version)
            self.manifest.commit(version + 1, content | {"shards": [asdict(s) for s in kept + made]})

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest.read()[1]["schema"]))

    def vacuum(self) -> None:
        """Delete the shards that only versions before the latest have."""
        latest, now = self.shards()
        keep, old = {s.path for s in now}, set()
        for version in self.manifest.versions():
            if version < latest:
                old |= {s.path for s in self.shards(version)[1]}
        for path in sorted(old - keep):
            self.manifest.delete(path)

    def read(self, version: int | None = None, shard_col: str = "shard") -> DataFrame:
        """The rows of a version and a struct (id, bytes, rows, tier, version) of each row's shard.

        The struct is named `shard_col`, with underscores added while the rows have a column of that name. A version
        into which only empty frames were appended has no rows; before the first append there is no schema: a ValueError.
        """
        version, shards = self.shards(version)
        if not version:
            raise ValueError("nothing was appended")
        schema = self.schema()
        free = lambda name: name if name not in schema.names else free(f"{name}_")
        at, name = free("_shard_path"), free(shard_col)
        if not shards:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast("struct<id:long,bytes:long,rows:long,tier:int,version:long>"))
        paths = sorted(shards, key=lambda s: s.path)
        told = self.spark.createDataFrame([(s.path, (k, s.bytes, s.rows, s.tier, version)) for k, s in enumerate(paths)], f"`{at}` string, `{name}` struct<id:long,bytes:long,rows:long,tier:int,version:long>")
        if len(shards) <= BROADCAST_SHARDS:
            told = F.broadcast(told)
        rows = self.spark.read.schema(schema).parquet(*(s.path for s in paths))
        return rows.withColumn(at, F.col("_metadata.file_path")).join(told, at).drop(at)

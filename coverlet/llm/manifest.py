"""Versioned manifests in shared storage, committed by one rename.

A version is one file of JSON text. It is written beside its place and renamed there; the rename fails when another
writer has committed that version first, so a version once visible is whole and never changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = self._path(f"{self.root}/_manifest")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def versions(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(self.folder))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version and its content, by default the latest; (0, {}) before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}
        stream = self.files.open(self._path(f"{self.folder}/v{version:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def commit(self, version: int, content: dict) -> int:
        """Publish a version; CommitConflict where it exists already."""
        self.files.mkdirs(self.folder)
        draft = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        place = self._path(f"{self.folder}/v{version:09d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            if self.files.exists(place):
                raise CommitConflict(f"version {version} of {self.root} exists")
            context.rename(draft, place, none)
        except CommitConflict:
            self.files.delete(draft, False)
            raise
        except Exception as e:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} of {self.root} exists") from e
            raise
        return version

    def delete(self, path: str) -> None:
        self.files.delete(self._path(path), True)

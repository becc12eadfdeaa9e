"""Connected components of a link table, without collecting links, nodes or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Nodes of a forest that one task holds before it passes the forest on.
FOREST = 500_000


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: what leaves is one link from each node to its root."""
    root: dict = {}
    schema = None

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def forest() -> pa.RecordBatch:
        out = [(x, top) for x in list(root) if (top := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema.field(k).type) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FOREST:
            yield forest()
    if root:
        yield forest()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the least node that can be reached.

    Links are first thinned by union-find, inside tasks. Then each node takes the least label among its
    neighbours and its label's own label (pointer jumping), until none changes. Each round is a table in the
    shared folder. Links with a null end are ignored; repeated links and self-links change nothing.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    thin = lambda df: df.mapInArrow(_spanning, f"a {kind}, b {kind}")
    # Thinned where they are, then again with each node's links in one task: hardly more links are left than nodes.
    edges = thin(thin(links).repartition("a"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select(F.inline(both)).distinct(), "edges", 16)
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp"))
    labels = stored(labels, "labels", 16)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        of = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        jumped = least.join(of, "comp", "left").select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "was")
        jumped = stored(jumped, "labels", 16)
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> was").isEmpty():
            return labels

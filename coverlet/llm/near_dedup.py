"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

Documents with equal shingle sets are one class; only classes are sketched, banded and compared. A band's
bucket is never expanded into pairs: each member is first compared with the bucket's leader, which joins most
members. Then, in buckets whose members are still in several components, members outside the main one are compared
with the others by signature, in blocks of bounded size: each sends its likeliest partner of another component to
verification, and after that all its likely partners that are still in other components. Where these are more than a
few, no pairs are made: their sets meet in blocks of bounded size, and one link an outlier and component leaves a
block. So only pairs that share a bucket are compared, and every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import integral, pieces, stored, texts_of
from .components import components
from .superminhash import bands, shingle_set, signatures

WIDTH, SHARE, OF = 5, 75, 100
SLOTS, BANDS, ROWS = 128, 32, 4
#: Estimated likeness from which a candidate is verified: over five standard errors below SHARE / OF.
LIKELY = 0.55
#: Members of a bucket, and shingles, that one comparison holds on each side, about.
BLOCK, SHINGLES = 2048, 1 << 20
#: Likely partners up to which a class's pairs leave a block; with more it is compared inside a task.
TAKE = 8
#: Rows of (class, document) up to which the list of candidates is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 1_000_000


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [shingle_set(x, width) for x in texts_of(batch.column(1))]
        sig = signatures(sets, SLOTS)
        keys = bands(sig, BANDS, ROWS)
        small = (sig ^ (sig >> np.uint64(29))).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([k.tolist() if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                pa.array([x.tobytes() if len(s) else None for x, s in zip(small, sets, strict=True)], pa.binary()),
            ],
            ["doc_id", "n_shingles", "node", "bands", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Full sets of the candidates; a row whose text is not its class's (a repeated doc_id) goes."""
    for batch in pieces(batches):
        sets = [shingle_set(x, width).tobytes() for x in texts_of(batch.column(1))]
        keep = [k for k, (node, s) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)) if s and xxhash.xxh3_128_digest(s) == node]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[k] for k in keep], pa.binary())], ["node", "shingles"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, SLOTS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array((a == b).mean(1) >= LIKELY)) for x in (batch.column(0), batch.column(1))], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], share: int, of: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, mine, keep = None, None, []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if a != last:
                last, mine = a, np.frombuffer(a, np.uint64)
            other = np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            keep.append(of * both >= share * (len(mine) + len(other) - both))
        yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in (batch.column(0), batch.column(1))], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows with equal first three columns, which follow each other, as one list of batches."""
    last, waiting = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([np.asarray(batch.column(k)) for k in range(3)], 1)
        cuts = (np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()
        for start, stop in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if waiting and tuple(at[start]) != last:
                yield waiting
                waiting = []
            last = tuple(at[start])
            waiting.append(batch.slice(start, stop - start))
    if waiting:
        yield waiting


def _screened(take: int):
    """Pairs (kind 0) of each outlier of a block (side 0) with its `take` likeliest members (side 1) of other components,
    among those that may be links. Above 1, outliers with more than `take` such members give no pairs: they and those
    members (kind 1: key, a, side) are to be compared by their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _blocks(batches):
            node, comp, sig, side = ([x for p in parts for x in p.column(k).to_pylist()] for k in range(3, 7))
            marks = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SLOTS)
            number: dict[bytes, int] = {}
            comps = np.fromiter((number.setdefault(x, len(number)) for x in comp), np.int64, len(comp))
            right = np.flatnonzero(side)
            known, theirs = marks[right], comps[right]
            rows, members = [], set()
            for x in np.flatnonzero(np.array(side) == 0):
                like = np.where(theirs != comps[x], (known == marks[x]).sum(1), 0)
                near = np.flatnonzero(like >= LIKELY * SLOTS)
                if take > 1 and len(near) > take:
                    rows.append((1, node[x], None, 0))
                    members.update(near.tolist())
                    continue
                for k in near if len(near) <= take else near[np.argsort(-like[near], kind="stable")[:take]]:
                    rows.append((0, *sorted((node[x], node[right[k]])), 0))
            rows += [(1, node[right[k]], None, 1) for k in members]
            if rows:
                key = parts[0].column(0)[0].as_py()
                columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), *columns], ["key", "kind", "a", "b", "side"])

    return run


_SCREENED = "key long, kind int, a binary, b binary, side int"


def _across(share: int, of: int):
    """Links of a block's outliers to its members of other components, by full sets: one for each outlier and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _blocks(batches):
            node, comp, sets, side = ([x for p in parts for x in p.column(k).to_pylist()] for k in range(3, 7))
            arrays = [np.frombuffer(x, np.uint64) for x in sets]
            comps = np.unique(comp, return_inverse=True)[1]
            right = np.flatnonzero(side)
            links = []
            if 0 < len(right) < len(node):
                known, flat = np.unique(np.concatenate([arrays[k] for k in right]), return_inverse=True)
                size = np.array([len(arrays[k]) for k in right])
                starts, theirs = np.cumsum(size) - size, comps[right]
                mark = np.zeros(len(known), np.int32)
                for x in np.flatnonzero(np.array(side) == 0):
                    mine = arrays[x]
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    at = at[known[at] == mine]
                    mark[at] = 1
                    both = np.add.reduceat(mark[flat], starts)
                    mark[at] = 0
                    linked = np.flatnonzero((of * both >= share * (len(mine) + size - both)) & (theirs != comps[x]))
                    links += [(node[x], node[right[k]]) for k in linked[np.unique(theirs[linked], return_index=True)[1]]]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _open_buckets(members: DataFrame, found: DataFrame, sig: DataFrame) -> DataFrame:
    """Blocks of the buckets whose members are in several components: outliers on side 0, members on side 1.

    Outliers are outside the component that has most of the bucket's members. Both sides are dealt to blocks of about
    BLOCK rows, so a bucket of any size is compared in tasks of bounded size.
    """
    placed = members.join(found, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    placed = placed.join(sizes, "key").join(sig, "node")
    outlier = F.col("comp") != F.col("main.comp")
    return _dealt(placed, F.lit(True), outlier, F.col("n"), F.col("n") - F.col("main.n"), BLOCK, "sig")


def _dealt(rows: DataFrame, member: Column, outlier: Column, n_members: Column, n_outliers: Column, block: int, *carried: str) -> DataFrame:
    """Rows (key, node, comp) dealt to blocks (i, j) of their key: each member to a j with every i, each outlier to an i with every j."""
    cut = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    n_right, n_left = cut(n_members), cut(n_outliers)
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.transform(every(n_left), lambda i: F.struct(i.alias("i"), mine(n_right).alias("j"), F.lit(1).alias("side")))
    as_outlier = F.transform(every(n_right), lambda j: F.struct(mine(n_left).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    both = F.concat(F.when(member, as_member).otherwise(none), F.when(outlier, as_outlier).otherwise(none))
    made = rows.select("key", F.inline(both), "node", "comp", *carried).select("key", F.col("i").cast("long"), F.col("j").cast("long"), "node", "comp", *carried, "side")
    return made.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _by_sets(marked: DataFrame, found: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    """Links among the marked rows (key, node, side) by their sets, in blocks of about SHINGLES shingles."""
    rows = marked.groupBy("key", "node").agg(F.max("side").alias("member"), F.min("side").alias("outlier")).join(sets, "node")
    rows = rows.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("n", F.octet_length("shingles") / 8)
    member, outlier = F.col("member") == 1, F.col("outlier") == 0
    rows = stored(rows, "marked")
    sizes = rows.groupBy("key").agg(F.sum(F.when(member, F.col("n")).otherwise(0)).alias("n_members"), F.sum(F.when(outlier, F.col("n")).otherwise(0)).alias("n_outliers"))
    dealt = _dealt(rows.join(sizes, "key"), member, outlier, F.col("n_members"), F.col("n_outliers"), SHINGLES, "shingles")
    return stored(dealt.mapInArrow(_across(share, of), "a binary, b binary"), "links", 16)


def _links(pairs: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""
    pairs = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return stored(pairs.mapInArrow(lambda it: _confirm(it, share, of), "a binary, b binary"), "links", 16)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id of its group), kept.

    Documents are linked when of * |intersection| >= share * |union| of their distinct `width`-word shingles
    (A-Z lower-cased, words split at ASCII white space; fewer words are one shingle). A null text is the empty
    text: it has no shingles and no links. A null doc_id takes no part in links: its component is null and it is
    kept. Repeated rows are one class; a doc_id with several texts belongs to each text's class and each of its rows is returned.
    Banding misses a link at the very threshold with probability below 1e-5. Other columns are not read. Ids are
    integers, else a TypeError.
    """
    docs = docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(docs.mapInArrow(lambda it: _sketch(it, width), "doc_id long, n_shingles long, node binary, bands array<long>, sig binary"), "sketches")
    classes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = stored(classes, "classes")

    banded = classes.select(F.explode("bands").alias("key"), "rep", "node")
    leaders = banded.groupBy("key").agg(F.min(F.struct("rep", "node")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(leaders, "key").select("key", F.col("lead.node").alias("leader"), "node"), "members")
    sig = classes.select("node", "sig")
    sets = members.select("node").distinct().join(classes.select("node", "rep"), "node")
    sets = stored(sets, "wanted", 16)
    if sets.count() <= BROADCAST_ROWS:
        sets = F.broadcast(sets)
    sets = docs.join(sets, docs.doc_id == sets.rep).select("node", "text").mapInArrow(lambda it: _sets(it, width), "node binary, shingles binary")
    sets = stored(sets.dropDuplicates(["node"]), "sets")

    stars = members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(sig.toDF("b", "t"), "b").join(sig.toDF("a", "s"), "a").select("a", "b", "s", "t").mapInArrow(_estimate, "a binary, b binary")
    links = _links(stars, sets, share, of)
    for take in (1, TAKE):
        found = components(links)
        screened = stored(_open_buckets(members, found, sig).mapInArrow(_screened(take), _SCREENED), "pairs", 4)
        links = links.union(_links(screened.where("kind = 0").select("a", "b").distinct(), sets, share, of))
    marked = screened.where("kind = 1").select("key", F.col("a").alias("node"), "side")
    if not marked.isEmpty():
        links = links.union(_by_sets(marked, found, sets, share, of))
    found = components(links)

    named = classes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF) -> DataFrame:
    """The documents without those that are not kept; columns stay as they are.

    A doc_id with several rows goes when none of them is kept. Rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, id_col, text_col, width, share, of).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = stored(gone.where("not kept").select(F.col("doc_id").alias("_gone")), "gone", 16)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")

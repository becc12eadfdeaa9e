"""Benchmark decontamination: test items of which a document contains most shingles.

MinHash containment search. Items are partitioned by size, in powers of two; an item's sketch is the least hashes of
its shingles under one random order (bottom-k MinHash), with a depth k that its partition's largest size sets, so that
an item with the wanted share of shingles in a document has one of its k sketched shingles there. Against long
documents banded signatures would lose short items, since their Jaccard similarity is near 0; this sketch loses none.
Each document's shingle hashes are looked up among the sketches, documents too small for an item's size partition are
passed over, and each hit is verified by exact containment: the item's whole set of 64-bit shingle hashes is
intersected with the document's. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH, SHARE = 5, 0.75
#: Bytes of sketches and items' sets, at ROW_BYTES a sketch row, up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 128 << 20, 64
#: Places that a sketch row is dealt to when it is shuffled.
SALTS = 8
#: Documents up to which a list of contaminated documents is broadcast.
BROADCAST_DOCS = 1_000_000


def normal(text: Column) -> Column:
    """A text's words, lower-cased runs of letters and digits, each between single spaces; no words: one space."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    return F.concat(F.lit(" "), F.ltrim(F.rtrim(words)), F.lit(" "))


def _words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def _gram_hashes(hashes: Column, width: int) -> Column:
    """Hashes of the shingles, from those of the words."""
    at = F.sequence(F.lit(0), F.size(hashes) - width)
    return F.when(F.size(hashes) >= width, F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once: the optimizer would put a column's expression at each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marks(text: Column) -> Column:
    """Hashes of a text's words."""
    return F.transform(_words(normal(text)), lambda w: F.xxhash64(w))


def item_sketches(items: DataFrame, item_col: str, text_col: str, share: float) -> DataFrame:
    """(item_id, width, n, need, size_class, hashes): one row an item with words, repeated ids by their text.

    An item of fewer than WIDTH words is one shingle of all its words. `need` of its n distinct shingles make a hit;
    size_class is the power of two that its partition begins with.
    """
    by_width = lambda m: reduce(lambda rest, w: F.when(F.size(m) == w, _gram_hashes(m, w)).otherwise(rest), range(1, WIDTH), _gram_hashes(m, WIDTH))
    made = _once(_marks(F.col(text_col)), lambda m: F.struct(F.least(F.lit(WIDTH), F.size(m)).alias("width"), F.array_sort(F.array_distinct(by_width(m))).alias("hashes")))
    rows = items.select(F.col(item_col).alias("item_id"), made.alias("made")).select("item_id", "made.*").where("width > 0").distinct().withColumn("n", F.size("hashes"))
    need, size_class = F.ceil(F.col("n") * share).cast("int"), F.floor(F.log2("n")).cast("int")
    return rows.select("item_id", "width", "n", need.alias("need"), size_class.alias("size_class"), "hashes")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): each item of which a document has at least `share` of the distinct shingles.

    Words are lower-cased runs of letters and digits, shingles five of them; a shorter item is one shingle of all its
    words. Null and empty texts, and those without words, contain nothing and are contained in nothing. Repeated
    rows give one result row, a null doc_id or item_id is a key of its own. Other columns are not read.
    """
    spark = docs.sparkSession
    items = stored(item_sketches(items, item_col, item_text_col, share), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    kind = docs.schema[id_col].dataType.simpleString()
    if not widths:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shingles int, n_found int, containment double")
    # A partition's depth follows from its largest size: of so many least hashes one is in any document with the needed share.
    most = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    depth = (most - F.ceil(most * share) + 1).cast("int")
    items = items.withColumn("item", F.struct("item_id", F.xxhash64("hashes").alias("text")))
    sketch = items.select("item", F.floor(F.pow(F.lit(2.0), F.col("size_class")) * share).cast("int").alias("room"), F.explode(F.slice("hashes", 1, F.least(depth, F.col("n")))).alias("hash"))
    sets = items.select(F.col("item").alias("of"), "n", "need", "hashes")
    grams = lambda m: F.flatten(F.array_compact(F.array(*(_gram_hashes(m, w) for w in widths))))
    made = _once(_marks(F.col(text_col)), lambda m: F.struct(F.size(m).alias("n_words"), F.array_distinct(grams(m)).alias("grams")))
    # Outer explodes below: an inner one would be filtered by a second computation of the shingles.
    texts = docs.select(F.col(id_col).alias("doc_id"), made.alias("made"))
    size = sketch.agg(F.count("*").alias("rows")).first().rows, items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = F.size(F.array_intersect("hashes", "grams"))
    if ROW_BYTES * size[0] + 8 * size[1] <= BROADCAST_BYTES:
        hits = texts.select("doc_id", "made", F.explode_outer("made.grams").alias("hash")).select("doc_id", "made.*", "hash").join(F.broadcast(sketch), "hash").where("n_words >= room")
        hits = hits.select("doc_id", "grams", "item").join(F.broadcast(sets), F.col("item") == F.col("of"))
        hits = hits.select("doc_id", "item", "n", "need", found.alias("found")).where("found >= need")
    else:
        # Hashes that many documents have and items ask for are hot: each sketch row is dealt to SALTS places.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        probes = texts.select("doc_id", "made.n_words", F.explode_outer("made.grams").alias("hash")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        pairs = probes.join(sketch.select("*", salts), ["hash", "salt"]).where("n_words >= room").select("doc_id", "item").distinct()
        hits = pairs.join(sets, F.col("item") == F.col("of")).drop("of").withColumnRenamed("doc_id", "d").join(texts.select("doc_id", "made.grams"), F.col("d").eqNullSafe(F.col("doc_id")))
        hits = hits.select("doc_id", "item", "n", "need", found.alias("found")).where("found >= need")
    best = hits.groupBy("doc_id", F.col("item.item_id").alias("item_id")).agg(F.max(F.struct(F.col("found") / F.col("n"), "n", "found")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").alias("n_shingles"), F.col("best.found").alias("n_found"), (F.col("best.found") / F.col("best.n")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The documents that contain no item; all columns stay. Rows of a contaminated doc_id all go."""
    bad = stored(contaminated(docs, items, id_col, text_col, item_col, item_text_col, share).select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    if bad.count() <= BROADCAST_DOCS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")

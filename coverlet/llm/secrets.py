"""Secrets in texts, told apart by who owns them across the corpus.

Candidates are found by fixed patterns. The hash of each candidate's value is counted over the whole corpus by
distinct repositories and distinct owners: a value that several owners or very many repositories have is a copied
example, one that a single owner has in few and that looks random is probably live. Owner-specific random-looking values beside the fixed patterns
are added as spans of kind "owned".
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, pieces, stored, texts_of

# The patterns of the base kinds, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "owned")

#: Runs of a size and alphabet that keys have; only random-looking ones are candidates.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}", re.ASCII)
#: Runs of at least LEAST["hex"]: as a run is matched from its start, the same spans as HEX with shorter ones dropped.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
#: Bits a character from which a run looks random, and owners and repositories up to which a value is not a copied
#: example: what one owner has in more repositories is a template of theirs.
BITS, OWNERS, REPOS = 3.0, 1, 100
#: Kinds whose surroundings say that a value is a secret: short or plain ones need not look random.
NAMED = ("assign", "access")
#: Documents with live spans, or values that many repositories have, up to which their list is broadcast (about 30 and
#: 24 bytes a row); beyond it is shuffled, values dealt to SALTS places each.
BROADCAST_ROWS, SALTS = 200_000, 32


def value_hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def entropy(value: str) -> float:
    """Bits a character by the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """At least BITS a character, with digits among other characters."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= BITS


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and non-overlapping within each kind; code points, end exclusive."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", m.start(), m.end(), m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """The base spans, and random-looking runs that touch none of them."""
    base = base_spans(text)
    more = []
    for m in _RUN.finditer(text):
        if looks_random(m[0]) and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
            more.append(("owned", m.start(), m.end(), m[0]))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def written(spans) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


_FOUND = "array<struct<kind:string,start:int,end:int,value:long,random:boolean>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", owners: int = OWNERS, repos: int = REPOS, values: bool = False) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_spans, n_live, n_example, spans.

    `spans` is an array of (kind, start, end, live, repos, owners): every base span and each "owned" one whose
    value is live. A span is live when at most `owners` owners and `repos` repositories have its value, and it is of a
    kind in NAMED or looks random, else an example. A null text is empty; null repositories or owners count as one of
    their own. Repeated rows are one repository and owner. With `values` a span also has its value's hash. Only the
    named columns are read. Ids are integers, else a TypeError.
    """
    named = docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(repo_col)).alias("repo"), F.xxhash64(F.col(owner_col)).alias("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())]))
        for batch in pieces(batches):
            found = [candidates(x.decode("utf-8", "replace")) for x in texts_of(batch.column(1))]
            base = [[s for s in x if s[0] != "owned"] for x in found]
            counts = [Counter(s[0] for s in x) for x in base]
            told = [[{"kind": k, "start": s, "end": e, "value": value_hash(v), "random": k in NAMED or looks_random(v)} for k, s, e, v in x] for x in found]
            columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]), pa.array([written(x) for x in base], pa.string()), pa.array(told, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_spans", "found"])

    rows = named.mapInArrow(run, f"doc_id long, repo long, owner long, n_assign long, n_access long, n_hex long, base_spans string, found {_FOUND}")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.inline("found"))
    per = each.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("*").alias("repos"))
    held = stored(per.groupBy("value").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners")), "values", 16)
    wide = held.where(F.col("repos") > repos)
    if wide.count() <= BROADCAST_ROWS:
        # Values that many repositories have would be hot keys; the others occur in few rows.
        wide = F.broadcast(wide)
        rare = each.join(wide.select("value"), "value", "left_anti").join(held.where(F.col("repos") <= repos), "value")
        judged = each.join(wide, "value").unionByName(rare)
    else:
        dealt = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["value", "salt"]).drop("salt")
    judged = judged.withColumn("live", F.col("random") & (F.col("owners") <= owners) & (F.col("repos") <= repos))
    judged = judged.where("kind <> 'owned' or live").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.array_position(F.lit(list(KINDS)), F.col("kind")).alias("rank"), "kind", "end", "live", "repos", "owners", "value"))).alias("spans"))
    out = rows.drop("found", "repo", "owner").join(judged, "row", "left").drop("row")
    spans = F.transform(F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.live.alias("live"), s.repos.alias("repos"), s.owners.alias("owners"), *([s.value.alias("value")] if values else [])))
    out = out.withColumn("spans", spans)
    live = F.size(F.filter("spans", lambda s: s.live))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_spans", live.cast("long").alias("n_live"), (F.size("spans") - live).cast("long").alias("n_example"), "spans")


def span_text(spans) -> F.Column:
    """All spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each union of overlapping spans replaced by the mask."""
    out, end = [], 0
    for start, stop in sorted(spans):
        if start >= end:
            out += [text[end:start], mask]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", mask: str = "<REDACTED>", chars_col: str = "n_chars") -> DataFrame:
    """The documents with each live span of their text replaced by `mask`; `chars_col`, if there, follows the text.

    All rows and columns stay. A null text stays null; null doc_ids are one id. Documents without live spans
    do not pass through Python. Repeated rows are treated alike. Ids are integers, else a TypeError.
    """
    free = lambda name: name if name not in docs.columns else free(f"{name}_")
    at_id, at_values = free("_id"), free("_values")
    values = F.transform(F.filter("spans", lambda s: s.live), lambda s: s.value)
    live = find_secrets(docs, id_col, text_col, repo_col, owner_col, values=True).where("n_live > 0")
    live = live.select(F.col("doc_id").alias(at_id), F.explode(values).alias("_v")).groupBy(at_id).agg(F.collect_set("_v").alias(at_values))
    live = stored(live, "live")
    if live.count() <= BROADCAST_ROWS:
        live = F.broadcast(live)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(at_id))
    calm = docs.join(live, same, "left_anti")
    hit = docs.join(live, same).drop(at_id)
    schema = hit.drop(at_values).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, last = names.index(text_col), len(names) - 1
            out = []
            for text, values in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                values = set(values)
                out.append(text if text is None else masked(text, [(s, e) for _, s, e, v in candidates(text) if value_hash(v) in values], mask))
            columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(last)]
            if chars_col in names:
                k = names.index(chars_col)
                columns[k] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names[:last])

    return calm.unionByName(hit.mapInArrow(run, schema))

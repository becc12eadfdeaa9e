"""Chat formatting of reply trees.

Messages point to their parents. Iterative self-joins, each of which doubles the distance, list every leaf's path to
its root; the paths of a tree are ranked by score, and each chosen path is formatted as one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """A text in which no control string can begin: a backslash more between each `<` and `|`."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_in(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def format_turns(turns: list[tuple[str, str]], learned: str = LEARNED_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans: (start, end) in code points of each learned role's text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_in(role)}\n", escape(text)
        out += [head, body, END, "\n"]
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted conversation was made of."""
    return [(_role_out(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, up): every node on the way from each leaf to its root, `up` steps above the leaf.

    nodes: (node, parent). A node whose parent is missing is a root. Nodes of a cycle have no leaf below them,
    and a leaf's way stops before it would enter a cycle again.
    """
    far = nodes.alias("n").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("above"))
    far = stored(far, "parents")
    leaves = nodes.select("node").join(far.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    ways = stored(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "ways")
    step, longest = 1, None
    while not far.isEmpty():
        if longest is None:
            longest = nodes.count()
        higher = ways.join(far, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        ways = stored(ways.union(higher), "ways")
        twice = far.select("node", F.col("above").alias("mid")).join(far.select(F.col("node").alias("mid"), "above"), "mid").select("node", "above")
        step *= 2
        far = stored(twice, "parents")
        if step > longest:
            break
    return ways.groupBy("leaf", "node").agg(F.min("up").alias("up"))


def format_trees(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """Each tree's best `paths` root-to-leaf paths (None: all) as conversations.

    messages: tree, node (unique), parent (null for a root), role, text, score. The result: tree, rank (from 1),
    score, n_turns, formatted, loss array<struct<start,end>>. A path's score is the mean of its messages' scores,
    a null score counting as 0; ties go to the longer path, then the smaller leaf. Null roles and texts are empty.
    """
    messages = stored(messages.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    ways = _paths(messages.select("node", "parent"))
    scored = ways.join(messages.select("node", "tree", "score"), "node")
    ranked = scored.groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("score"), F.count("*").alias("n_turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    chosen = ranked.where(F.col("rank") <= paths) if paths else ranked
    told = ways.join(chosen.select("leaf"), "leaf", "left_semi").join(messages.select("node", "role", "text"), "node")
    told = told.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    rows = chosen.join(told, "leaf").select("tree", "rank", "score", "n_turns", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns(list(zip(r, t, strict=True))) for r, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": s, "end": e} for s, e in m[1]] for m in made], loss)], ["tree", "rank", "score", "n_turns", "formatted", "loss"])

    kind = rows.schema["tree"].dataType.simpleString()
    return rows.mapInArrow(run, f"tree {kind}, rank int, score double, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def chains(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of linear conversations for format_trees: each turn replies to the one before.

    Turns go by number, repeated or null numbers by role and text (nulls first); null conversation ids are one
    conversation. Other columns are not read.
    """
    order = Window.partitionBy("tree").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    tree = F.struct(F.col(id_col).alias("id"))
    rows = rows.select(tree.alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).withColumn("at", F.row_number().over(order))
    node = lambda at: F.struct("tree.id", at.alias("at"))
    key = lambda at: F.to_json(node(at), {"ignoreNullFields": "false"})
    return rows.select("tree", key(F.col("at")).alias("node"), F.when(F.col("at") > 1, key(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(made: DataFrame) -> DataFrame:
    """What is read back from (conv_id, formatted, loss): turn and loss digests, and lengths in code points."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return made.select(F.col("conv_id").cast("long"), "formatted", "loss").mapInArrow(run, schema)

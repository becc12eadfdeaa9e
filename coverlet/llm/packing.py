"""Packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing by the dot-product heuristic (Panigrahy et al., 2011): the open bin takes, among the examples
that fit in every dimension, the one whose demand vector has the greatest dot product with what the bin has left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, pieces, texts_of
from .tokens import REMEMBERED, ChunkEncoder

#: Bytes of text that are encoded at one time.
PIECE_BYTES = 6 << 20
#: Sequences made before newly made kinds of piece are looked at.
_ROUND = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and whether examples that would fit in a sequence of their own may be cut."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    cuts: bool = True


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    loss: int
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        """The first `length` tokens and the rest; loss-bearing tokens are the last ones of a piece."""
        loss = max(0, length - (len(self) - self.loss))
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * length], loss, self.doc_tokens),
            Piece(self.doc_id, self.start + length, self.ids[4 * length :], self.loss - loss, self.doc_tokens),
        )

    def longest(self, tokens: int, loss: int) -> int:
        """The longest beginning within `tokens` tokens and `loss` loss-bearing ones."""
        return min(tokens, len(self), len(self) - self.loss + loss)


class Packer:
    """Packs a stream of examples; what is not yet placed waits for the next ones."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.waiting: dict[tuple[int, int], list[Piece]] = {}
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        """Take an example, cut to what a sequence may hold. None leaves alone: a full sequence without loss-bearing
        tokens would leave too few others beside those that bear loss."""
        while (fits := piece.longest(self.limits.tokens, self.limits.loss)) < len(piece):
            first, piece = piece.cut(fits)
            self._wait(first)
        if len(piece):
            self._wait(piece)

    def _wait(self, piece: Piece) -> None:
        self.waiting.setdefault((len(piece), piece.loss), []).append(piece)
        self.tokens += len(piece)

    def _take(self, kind: tuple[int, int]) -> Piece:
        piece = self.waiting[kind].pop()
        if not self.waiting[kind]:
            del self.waiting[kind]
        self.tokens -= len(piece)
        return piece

    def sequences(self, least: int) -> Iterator[list[Piece]]:
        """Sequences, until fewer than `least` tokens wait."""
        full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        while self.tokens >= max(1, least):
            # Of each kind (length, loss) a row; those that a cut makes join at the next round.
            kinds = list(self.waiting)
            demand = np.array([(n, 1, loss) for n, loss in kinds], float)
            worth = demand / (full * full)
            count = np.array([len(self.waiting[k]) for k in kinds])
            index = {k: i for i, k in enumerate(kinds)}
            for _ in range(_ROUND):
                if self.tokens < max(1, least) or not count.any():
                    break
                left, out, cut = full.copy(), [], []
                while left[0] >= 1 and left[1] >= 1:
                    gain = np.where((count > 0) & (demand[:, 0] <= left[0]) & (demand[:, 2] <= left[2]), worth @ left, -1)
                    at = int(gain.argmax())
                    size = 0
                    if gain[at] < 0:
                        # None fits whole: cut the one that fills most, of equals the longest.
                        room = np.minimum(left[0], demand[:, 0] - demand[:, 2] + left[2])
                        at = int(np.where(count > 0, room + demand[:, 0] / (1 + full[0]), -1).argmax())
                        if not self.limits.cuts or not count[at]:
                            break
                        size = self.waiting[kinds[at]][-1].longest(int(left[0]), int(left[2]))
                        if size < 1:
                            break
                    piece = self._take(kinds[at])
                    count[at] -= 1
                    if size:
                        piece, rest = piece.cut(size)
                        self._wait(rest)
                        cut.append((len(rest), rest.loss))
                    out.append(piece)
                    left -= (len(piece), 1, piece.loss)
                    if cut and not count.any():
                        break
                yield out
                for kind in cut:
                    if kind in index:
                        count[index[kind]] += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, limits: Limits | None = None, end_id: int = 1, remembered: int = REMEMBERED, loss_share: float = 1.0) -> DataFrame:
    """One row a piece of a packed example: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    An example is its text's ids by the tokenizer at the path `tokenizer`, then `end_id`. A null text is empty and
    gives the end alone; a null doc_id is kept. `loss_col` has the number of an example's last tokens that bear
    loss (null or no column: the share `loss_share` of them, rounded down). Examples beyond a limit are cut; with limits.cuts others may be, so
    that sequences fill up. Repeated rows are packed as often as they occur. Each task packs the rows it reads,
    so nothing is shuffled and only a task's last few sequences may be left short; other columns are not read. `remembered`
    chunks of text stay encoded in a worker: more of them take memory and save time. Ids are integers, else a TypeError.
    """
    limits = limits or Limits()
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("each limit must be at least 1")
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = ChunkEncoder.at(tokenizer, remembered), Packer(limits)
        end, number = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId() << 40

        def rows(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out = []
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset, p.loss))
                    offset += len(p)
                number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in pieces(batches, limit=PIECE_BYTES):
            encoded = encoder.encode(texts_of(batch.column(1)))
            for doc_id, ids, bears in zip(batch.column(0).to_pylist(), encoded, batch.column(2).to_pylist(), strict=True):
                n = len(ids) // 4 + 1
                packer.add(Piece(doc_id, 0, ids + end, int(n * loss_share) if bears is None else min(n, max(0, bears)), n))
            yield from rows(packer.sequences(limits.tokens * 64))
        yield from rows(packer.sequences(1))

    return docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss")).mapInArrow(run, SCHEMA)

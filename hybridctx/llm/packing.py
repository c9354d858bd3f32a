"""Packing token sequences by vector bin packing with the dot-product heuristic.

Every example is a vector (tokens, 1 segment, loss-bearing tokens); a sequence has the limits (max_tokens,
max_segments, max_loss). While a sequence is open, the waiting example that fits with the largest dot product of its
vector with the remaining capacities (both in units of the limits, so the scarcest resource weighs most) is
placed. Ties go to the earlier example. When nothing fits whole and cutting is allowed, the waiting example with
the largest product is cut: its head fills the sequence up to max_tokens or the loss limit, its tail waits on.

Cutting: an example longer than max_tokens first gives whole sequences of its own. What is left open at the end of a
task's rows is laid out in sequences whose lengths are falling powers of two, which need no padding either.

Scale: each task tokenises and packs the rows of its own partition, with a window of `pool` waiting examples, or as many
more as it takes to hold max_tokens or max_segments, so short examples are not padded for want of others; there is no
shuffle, no global order and no sequence that spans tasks. Sequence ids are (partition, number), so a retried task
gives the same ids.

Defined results: null text is empty (one piece: the end id); empty tables give no rows; repeated rows are packed
as separate documents; extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hybridctx.llm import words as W
from hybridctx.llm.unit_cache import unit_cache

PIECE = [("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()),
         ("ids_crc32", T.LongType(), pa.int64()), ("doc_tokens", T.LongType(), pa.int64()),
         ("sequence_id", T.LongType(), pa.int64()), ("offset", T.LongType(), pa.int64()),
         ("loss_tokens", T.LongType(), pa.int64())]
#: Sequences of one partition are numbered below this.
PER_PARTITION = 1 << 40


class Packer:
    """Packs examples (key, ids, loss mask or None) in the order they come; emit() receives finished pieces."""

    def __init__(self, first_id: int, emit: Callable, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("a sequence holds at least one token, one segment and one loss-bearing token")
        self.next_id, self.emit, self.pool = first_id, emit, pool
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        # waiting examples in NumPy columns: demand vectors beside the objects they belong to
        self.demand = np.zeros((max(pool, max_segments) + 1, 3), np.float64)
        self.items: list = []

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None):
        n, at, size = len(ids), 0, int(self.limits[0])
        whole = loss is None and self.limits[2] >= self.limits[0]
        while whole and n - at >= size:  # whole sequences of its own
            self._piece(key, ids, loss, at, at + size, self.next_id, 0)
            self.next_id, at = self.next_id + 1, at + size
        if at < n:
            self._push(key, ids, loss, at)
        while len(self.items) >= self.pool and self._enough():
            self._fill()

    def _enough(self) -> bool:
        """Whether the waiting examples reach the limit of tokens or of segments."""
        n = len(self.items)
        return n >= self.limits[1] or self.demand[:n, 0].sum() >= self.limits[0]

    def _push(self, key, ids, loss, at):
        self.demand[len(self.items)] = (len(ids) - at, 1, self._loss(ids, loss, at, len(ids)))
        self.items.append((key, ids, loss, at))

    @staticmethod
    def _loss(ids, loss, a, b) -> int:
        return b - a if loss is None else int(loss[a:b].sum())

    def _pop(self, i):
        item = self.items.pop(i)
        n = len(self.items)
        self.demand[i:n] = self.demand[i + 1:n + 1]
        return item

    def _piece(self, key, ids, loss, a, b, seq, offset):
        self.emit(key, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), seq, offset,
                  self._loss(ids, loss, a, b))

    def _head(self, item, room) -> int:
        """End of the longest head of an example that fits the remaining (tokens, loss) room."""
        _, ids, loss, at = item
        end = min(len(ids), at + int(room[0]))
        if loss is None:
            return min(end, at + int(room[2]))
        over = np.flatnonzero(np.cumsum(loss[at:end]) > room[2])
        return at + int(over[0]) if len(over) else end

    def _fill(self):
        """One sequence from the waiting examples."""
        room, offset = self.limits.copy(), 0
        while self.items and room[0] >= 1 and room[1] >= 1:
            d = self.demand[:len(self.items)]
            score = (d / self.limits) @ (room / self.limits)
            fits = (d <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                key, ids, loss, at = self._pop(i)
                end = len(ids)
            else:
                i = int(np.argmax(score))
                end = self._head(self.items[i], room)
                key, ids, loss, at = self.items[i]
                if end <= at:  # not one more token within the loss limit
                    break
                self._pop(i)
            self._piece(key, ids, loss, at, end, self.next_id, offset)
            offset += end - at
            room -= (end - at, 1, self._loss(ids, loss, at, end))
            if end < len(ids):
                self._push(key, ids, loss, end)
        self.next_id += 1

    def close(self):
        """Lay out what waits: full sequences while they last, then falling powers of two."""
        size = int(self.limits[0])
        while self.items and self.demand[:len(self.items), 0].sum() >= size:
            self._fill()
        full, rest = self.limits.copy(), int(self.demand[:len(self.items), 0].sum())
        while self.items:
            self.limits = full.copy()
            self.limits[0] = min(size, 1 << (max(1, rest).bit_length() - 1))
            self._fill()
            rest = int(self.demand[:len(self.items), 0].sum())
        self.limits = full


def document_ids(vocabulary: str, end_id: int) -> Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]:
    """Encoder of plain documents: (row, ids with end_id) through the exact unit cache of a vocabulary that drops
    white space."""
    def encode(texts):
        cache = unit_cache(vocabulary, "word", True)
        for a, b, data, offs in W.slices(texts):
            ids, rows = cache.row_ids(data, offs)
            for k in range(b - a):
                one = np.empty(rows[k + 1] - rows[k] + 1, np.uint32)
                one[:-1], one[-1] = ids[rows[k]:rows[k + 1]], end_id
                yield a + k, one
    return encode


def pack(docs: DataFrame, encode: Callable, max_tokens: int = 4096, max_segments: int = 512,
         max_loss: int | None = None, pool: int = 256, id_col: str = "doc_id", text_col: str = "text",
         loss_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    encode(texts) yields (row, ids) in row order. loss_of(ids) gives the mask of loss-bearing tokens (default: all).
    max_loss defaults to max_tokens."""
    names = [id_col, *(n for n, _, _ in PIECE)]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           *(T.StructField(n, t) for n, t, _ in PIECE)])
    most_loss = max_tokens if max_loss is None else max_loss

    def run(batches):
        out: list[tuple] = []
        packer = Packer(TaskContext.get().partitionId() * PER_PARTITION, lambda *piece: out.append(piece),
                        max_tokens, max_segments, most_loss, pool)
        id_type = None

        def rows():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *(pa.array(c, t) for c, (_, _, t) in zip(cols[1:], PIECE))], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0)
            for row, ids in encode(batch.column(1)):
                packer.add(keys[row].as_py(), ids, loss_of(ids) if loss_of else None)
                if len(out) >= 20_000:
                    yield rows()
        packer.close()
        if out:
            yield rows()

    return docs.select(id_col, text_col).mapInArrow(run, schema)

"""Operator 1: best-fit-decreasing packing of documents into token windows.

Documents become token ids, each followed by an end id. A document of more than a window is first cut into full windows; its
rest, and every shorter document, goes to the open window that it fills best. A segment tree indexed by remaining capacity
finds that window in logarithmic time.

The operator is narrow: every task packs the documents of its own partition, holding at most ``buffer_tokens`` ids in
``buffer_pieces`` pieces, and nothing is shuffled. Each buffer leaves at most a few windows part-filled among its thousands, so partitions should hold some
ten megabytes of text (``common.merged_partitions`` merges smaller scan splits).

Defined results: a null text counts as empty and still gives its end id; an empty table gives no rows; repeated rows are
packed once each; ties between equal lengths go to the earlier document; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dupescope.llm.common import bounded_batches
from dupescope.llm.tokens import word_ids

#: Ids and pieces that a task holds before it packs them; empty texts are pieces of one id.
BUFFER_TOKENS, BUFFER_PIECES = 4 << 20, 1 << 17


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of how many there are, and a stack at each leaf."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, and that capacity."""
        node = need + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: nothing to the right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.stacks[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length (1 to ``window``) its window and its offset there; how many windows there are."""
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if (found := free.take(need)) is None:
            found, n = (n, window), n + 1
        where[i], capacity = found
        offset[i] = window - capacity
        if capacity > need:
            free.put(capacity - need, found[0])
    return where, offset, n


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", buffer_tokens: int = BUFFER_TOKENS, buffer_pieces: int = BUFFER_PIECES) -> DataFrame:
    """One row for each piece: the id column, ``start`` (ids of the document before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (gapless from 0 in its sequence) and ``ids`` (little-endian unsigned 32-bit integers).

    ``sequence_id`` is the partition's number times 2**33 plus a count, so a task that is run again gives the same rows.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], dtype="<u4")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, next_id = word_ids(vocabulary), TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # id, start, ids, tokens of its document
        size = 0

        def rows(pieces: list[tuple], where: np.ndarray, offset: np.ndarray, types: pa.DataType) -> pa.RecordBatch:
            long = lambda xs: pa.array(xs, type=pa.int64())
            return pa.record_batch([pa.array([p[0] for p in pieces], type=types), long([p[1] for p in pieces]), long([len(p[2]) for p in pieces]), long([p[3] for p in pieces]), long(where), long(offset), pa.array([p[2].tobytes() for p in pieces], type=pa.binary())], names=out.names)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, next_id
            where, offset, n = best_fit_decreasing(np.array([len(p[2]) for p in held], dtype=np.int64), window)
            for lo in range(0, len(held), 1024):
                yield rows(held[lo : lo + 1024], where[lo : lo + 1024] + next_id, offset[lo : lo + 1024], types)
            held, size, next_id = [], 0, next_id + n

        types = None
        for batch in batches:
            keys, types = batch.column(0).to_pylist(), batch.column(0).type
            for key, ids in zip(keys, encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                full = len(ids) // window
                if full:
                    yield rows([(key, k * window, ids[k * window : (k + 1) * window], len(ids)) for k in range(full)], next_id + np.arange(full), np.zeros(full, dtype=np.int64), types)
                    next_id += full
                if len(ids) > full * window:
                    held.append((key, full * window, ids[full * window :], len(ids)))
                    size += len(ids) - full * window
                if size >= buffer_tokens or len(held) >= buffer_pieces:
                    yield from packed()
        if held:
            yield from packed()

    return docs.select(id_col, text_col).mapInArrow(task, out)

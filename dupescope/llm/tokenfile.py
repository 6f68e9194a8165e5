"""Operator 8: token ids in a binary file format of patched frame-of-reference blocks.

A table of segments, written by Spark's own writer into a folder that all executors share, so that its commit protocol,
retries and any file system that Spark reads work as usual. A row is a segment: ``part`` and ``segment`` (files ascend by
part, then segment), ``start`` (ids of the part before it), ``doc_ids`` and ``doc_lengths`` of its documents, and ``data``,
a self-contained byte string (all numbers little-endian):

    magic "PFR1" | u32 ids in a block | u64 ids | u32 blocks
    index, for each block: u64 start in the payload | u32 minimum | u32 exceptions | u8 width
    payload, for each block: packed residuals (value - minimum, ``width`` bits each, most significant bit first)
                             | u16 positions of the exceptions | u32 their residuals

A block's width is the smallest in which ``percentile`` of its residuals fit; larger ones are stored as exceptions. The
index gives any block's place, so a range of ids is read without the blocks before it.

Defined results: a null text counts as empty and still gives its end id; null ids come first; rows with equal ids are ordered
by text; an empty table gives no segments; other columns of the input are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dupescope.llm.common import bounded_batches
from dupescope.llm.tokens import word_ids

MAGIC, HEADER = b"PFR1", struct.Struct("<4sIQI")
INDEX = np.dtype([("start", "<u8"), ("minimum", "<u4"), ("exceptions", "<u4"), ("width", "u1")])
BLOCK, PERCENTILE = 1024, 0.9
#: Ids in a segment before a new one is begun.
SEGMENT_TOKENS = 1 << 20
SEGMENT_SCHEMA = "part int, segment int, start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, data binary"


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``values`` packed at ``width`` bits each."""
    whole = 16 if width <= 16 else 32
    bits = np.unpackbits(values.astype(f">u{whole // 8}").view(np.uint8).reshape(*values.shape, whole // 8), axis=-1)[..., whole - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def _values(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    whole = 16 if width <= 16 else 32
    bits = np.zeros((len(packed), block, whole), dtype=np.uint8)
    bits[..., whole - width :] = np.unpackbits(packed, axis=1, count=block * width).reshape(len(packed), block, width)
    return np.packbits(bits.reshape(len(packed), -1), axis=1).view(f">u{whole // 8}").astype(np.uint32)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    index = np.zeros(blocks, dtype=INDEX)
    if not n:
        return HEADER.pack(MAGIC, block, 0, 0)
    grid = np.full(blocks * block, ids[-1], dtype=np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, block)
    index["minimum"] = low = grid.min(axis=1)
    rest = grid - low[:, None]
    need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # the bit length of each residual
    k = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    index["width"] = width = np.partition(need, k, axis=1)[:, k]
    out_of = need > width[:, None]
    index["exceptions"] = many = out_of.sum(axis=1)
    sizes = -(-block * width.astype(np.int64) // 8) + 6 * many
    index["start"] = np.cumsum(sizes) - sizes
    payload: list[bytes] = [b""] * blocks
    slots = np.where(out_of, 0, rest)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for i, row in zip(at.tolist(), _bits(slots[at], w) if w else [b""] * len(at), strict=True):
            payload[i] = row.tobytes() if w else b""
    for i in np.flatnonzero(many).tolist():
        at = np.flatnonzero(out_of[i])
        payload[i] += at.astype("<u2").tobytes() + rest[i, at].astype("<u4").tobytes()
    return HEADER.pack(MAGIC, block, n, blocks) + index.tobytes() + b"".join(payload)


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (the end, if none) of a segment; only the blocks that hold them are read."""
    magic, block, n, blocks = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, dtype="<u4")
    index = np.frombuffer(data, dtype=INDEX, count=blocks, offset=HEADER.size)
    payload = np.frombuffer(data, dtype=np.uint8, offset=HEADER.size + index.nbytes)
    lo, hi = first // block, -(-last // block)
    index = index[lo:hi]
    start, width = index["start"].astype(np.int64), index["width"].astype(np.int64)
    grid = np.zeros((hi - lo, block), dtype=np.uint32)
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            size = -(-block * w // 8)
            grid[at] = _values(payload[start[at][:, None] + np.arange(size)], w, block)
    for i in np.flatnonzero(index["exceptions"]).tolist():
        k, at = int(index["exceptions"][i]), int(start[i] - (-block * width[i] // 8))
        places = payload[at : at + 2 * k].view("<u2") if at % 2 == 0 else np.frombuffer(payload[at : at + 2 * k].tobytes(), dtype="<u2")
        grid[i, places] = np.frombuffer(payload[at + 2 * k : at + 6 * k].tobytes(), dtype="<u4")
    grid += index["minimum"][:, None]
    return grid.ravel()[first - lo * block : last - lo * block].astype("<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents in ascending id order. Only ids and texts are shuffled (by ranges of the id); ids are made after it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    end = np.array([end_id], dtype="<u4")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_ids(vocabulary), TaskContext.get().partitionId()
        keys: list = []
        held: list[np.ndarray] = []
        segment = start = size = 0

        def row() -> pa.RecordBatch:
            long = pa.list_(pa.int64())
            one = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], long), pa.array([[len(x) for x in held]], long), pa.array([encode_segment(np.concatenate(held))], pa.binary())]
            return pa.record_batch(one, names=["part", "segment", "start", "n_ids", "doc_ids", "doc_lengths", "data"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= SEGMENT_TOKENS:
                    yield row()
                    segment, start, size, keys, held = segment + 1, start + size, 0, [], []
        if keys:
            yield row()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_id = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    by_id.mapInArrow(task, SEGMENT_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian
    unsigned 32-bit integers). Totals are summed by part: as many rows as the writer had partitions, whatever their size."""
    bounded_batches(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, keys, sizes, data = (c[r].as_py() for c in batch.columns)
                ids = decode_segment(data)
                ends = np.cumsum(np.array(sizes, dtype=np.int64))
                for lo in range(0, len(keys), 2048):
                    at = ends[lo : lo + 2048]
                    begun = at - np.array(sizes[lo : lo + 2048], dtype=np.int64)
                    yield pa.record_batch([pa.array(keys[lo : lo + 2048], pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(begun + start), pa.array(at - begun), pa.array([ids[x:y].tobytes() for x, y in zip(begun.tolist(), at.tolist(), strict=True)], pa.binary())], names=["doc_id", "part", "at", "n_tokens", "ids"])

    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = files.select("part", "start", "doc_ids", "doc_lengths", "data").mapInArrow(task, "doc_id bigint, part int, at bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")

"""Operator 13: lines that stand in several documents stay only in the first one.

A line's key is the line without white space at its ends, A-Z in lower case; keys of LEAST code points or more take part. Each
such line becomes a row of numbers (128 bits of its key's hash, document, place), written once. The rows are dealt to ranges of
(hash, document, place) and sorted, so a line of a third of all documents fills several partitions instead of one. A worker streams
the sorted rows: the first document of each hash keeps its lines, the others lose them. What a partition can't know is whether
its first hash began in an earlier one. It returns the rows of that hash's first document as open, and the hash that it ends with
and the document where that began; a join on hashes, with one row for each partition, decides the open ones. The places that
go become a compressed bitmap for each document that loses lines, and only those bitmaps meet the texts again.

Defined results: a null or empty text is one empty line; lines are split at ``\\n`` alone; documents are ordered by id, rows without
an id are one document that comes last; rows of the same id are one document too, each with its own bitmap (rows of the same id and
text are told apart by nothing); an empty table gives no rows; other columns pass through ``deduplicated`` unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupescope.llm.common import bounded_batches, runs, written

WHITE = " \t\n\x0b\x0c\r"
#: Code points that a key has at least.
LEAST = 10
GONE, OPEN, EDGE = 0, 1, 2


def line_keys(texts: list[str | None], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines whose key takes part: both halves of the hash, the text's number, the line's place; and each text's lines."""
    lines = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), "\n")
    many = np.diff(lines.offsets.to_numpy())
    flat = pc.ascii_lower(pc.ascii_trim(lines.flatten(), WHITE))
    some = np.flatnonzero(pc.greater_equal(pc.utf8_length(flat), least).to_numpy(zero_copy_only=False))
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join(map(digest, flat.take(pa.array(some)).cast(pa.large_binary()).to_pylist())), dtype=">i8").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), many)[some]
    return both[::2], both[1::2], text, some - (np.cumsum(many) - many)[text], many


def lines_of(docs: DataFrame, id_col: str, least: int) -> DataFrame:
    """``h1``, ``h2``, the id, ``row``, ``place`` and ``lines`` for every line that takes part; ``docs``: id, row, text."""
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), docs.schema[id_col], T.StructField("row", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("lines", T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in runs(texts):
                h1, h2, text, place, many = line_keys(texts[lo:hi], least)
                at = pa.array(text + lo)
                yield pa.record_batch([pa.array(h1), pa.array(h2), b.column(0).take(at), b.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(many[text].astype(np.int32))], names=schema.names)

    return docs.mapInArrow(task, schema)


def differs(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether a value is another than the one before it (nulls are equal); ``before``: the last one of the rows before."""
    whole = pa.concat_arrays([before if before is not None else column[:0], column])
    new = pc.fill_null(pc.not_equal(whole[1:], whole[:-1]), False).to_numpy(zero_copy_only=False) | (whole[1:].is_null().to_numpy(zero_copy_only=False) != whole[:-1].is_null().to_numpy(zero_copy_only=False))
    return new if before is not None else np.concatenate([[True], new]) if len(column) else new


def marks(lines: DataFrame, id_col: str) -> DataFrame:
    """Rows that go, rows that are open and an edge for each partition, as ``what``; ``lines`` is sorted over all partitions."""
    schema = T.StructType([T.StructField("what", T.IntegerType()), T.StructField("part", T.IntegerType()), *lines.schema.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None  # the last row so far, and the row with which its hash began
        begun: pa.RecordBatch | None = None
        opened, later = True, False  # still in the partition's first hash; past the first document of the present hash

        def out(what: int, rows: pa.RecordBatch) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.record_batch([pa.array([what] * n, pa.int32()), pa.array([part] * n, pa.int32()), *rows.columns], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            n, before = b.num_rows, None if last is None else [c[-1:] for c in last.columns]
            new = differs(b["h1"], before and before[0]) | differs(b["h2"], before and before[1])
            other = differs(b[id_col], before and before[2]) & ~new
            run = np.cumsum(new)  # 0: the hash of the rows before
            starts = np.flatnonzero(new)
            changes = np.cumsum(other)
            base = np.concatenate([[-int(later)], changes[starts]])  # changes of document before the hash began
            gone = changes - base[run] > 0
            first = opened & (run == (0 if last is not None else 1))
            if gone.any():
                yield out(GONE, b.filter(pa.array(gone)))
            if (first & ~gone).any():
                yield out(OPEN, b.filter(pa.array(first & ~gone)))
            opened, later = bool(first[-1]), bool(gone[-1])
            begun = b.slice(int(starts[-1]), 1) if len(starts) else begun
            last = b.slice(n - 1, 1)
        if begun is not None:
            yield out(EDGE, begun)

    return lines.mapInArrow(task, schema)


def packed(gone: list[int], lines: int) -> bytes:
    """A bit for each line, 1 if it stays, compressed."""
    keep = np.ones(lines, dtype=np.uint8)
    keep[gone] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpacked(bitmap: bytes, lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=lines).astype(bool)


def row_key(text_col: str) -> Column:
    """Tells rows of the same id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """For each document that loses lines: its id, ``row`` (``row_key`` of its text), ``lines``, ``dropped`` and ``keep``, a compressed
    bitmap with a bit for each line."""
    bounded_batches(docs.sparkSession)
    lines = written(lines_of(docs.select(F.col(id_col).alias("doc"), row_key(text_col).alias("row"), F.col(text_col).alias("text")), "doc", least), "lines")
    order = ["h1", "h2", F.col("doc").asc_nulls_last(), "row", "place"]
    marked = written(marks(lines.repartitionByRange(*order).sortWithinPartitions(*order), "doc"), "line-marks")
    edge = marked.where(F.col("what") == EDGE).groupBy("h1", "h2").agg(F.min_by(F.struct("part", "doc"), "part").alias("begun"))
    late = marked.where(F.col("what") == OPEN).join(edge, ["h1", "h2"]).where((F.col("begun.part") < F.col("part")) & ~F.col("begun.doc").eqNullSafe(F.col("doc")))
    gone = marked.where(F.col("what") == GONE).unionByName(late.select(*marked.columns))
    by_document = gone.groupBy("doc", "row").agg(F.first("lines").alias("lines"), F.collect_set("place").alias("gone"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("lines", T.IntegerType()), T.StructField("dropped", T.IntegerType()), T.StructField("keep", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [packed(g, n) for g, n in zip(b["gone"].to_pylist(), b["lines"].to_pylist(), strict=True)]
            yield pa.record_batch([b["doc"], b["row"], b["lines"], pc.list_value_length(b["gone"]), pa.array(keep, pa.binary())], names=schema.names)

    return by_document.mapInArrow(task, schema)


@F.pandas_udf(T.StringType())
def kept_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines of a text that its bitmap keeps; null where there is no bitmap."""
    out = []
    for t, k in zip(text, keep, strict=True):
        if k is None:
            out.append(None)
            continue
        lines = t.split("\n")
        out.append("\n".join(line for line, stays in zip(lines, unpacked(k, len(lines)).tolist(), strict=True) if stays))
    return pd.Series(out, dtype=object)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the text's remaining lines, and a last column ``line_dedup``: a struct of ``lines`` before and ``dropped``."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, least).select(F.struct(F.col(id_col).alias("doc"), "row", "dropped", "keep").alias("_bitmap"))
    both = docs.join(bitmaps, F.col(id_col).eqNullSafe(F.col("_bitmap.doc")) & (row_key(text_col) == F.col("_bitmap.row")), "left")
    text = F.coalesce(text_col, F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    keep = F.col("_bitmap.keep")
    kept = F.coalesce(kept_lines(F.when(keep.isNotNull(), F.col(text_col)), keep), F.col(text_col))
    others = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return both.select(*others, F.struct(lines.cast("bigint").alias("lines"), F.coalesce("_bitmap.dropped", F.lit(0)).cast("bigint").alias("dropped")).alias("line_dedup"))

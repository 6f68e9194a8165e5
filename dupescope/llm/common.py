"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.session import scratch_path

#: One Arrow batch sent to a Python worker holds at most this many bytes (rows of very long texts come in few-row batches).
ARROW_BATCH_BYTES = 8 << 20
#: Text, as the scan counts it, that a task should have at least where its size matters.
TASK_BYTES = 32 << 20
#: Texts are handled in runs of about this many characters inside a batch, which bounds a worker's intermediates.
RUN_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already has a tighter bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).isdigit() or int(now) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def id_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold rule of the held-out sets (a null id is in fold -1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)), F.lit(-1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def runs(texts: list[str | None], most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``most`` characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: cuts lineage, and a lost executor only reads it again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z in lower case, in one byte string where the words of a text stand one
    space apart: the bytes, each word's start and end, and how many words each text has."""
    low = pc.ascii_lower(pa.array([t or "" for t in texts], type=pa.string()))
    words = pc.ascii_split_whitespace(low)
    flat = words.flatten()
    size = pc.binary_length(flat).to_numpy()
    real = size > 0  # a text that begins or ends with white space has an empty word there
    many = np.diff(np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy() - words.offsets[0].as_py()])
    flat, size = flat.filter(pa.array(real)), size[real].astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")
    data = np.frombuffer(joined.buffers()[2], dtype=np.uint8, count=int(size.sum()) + max(0, len(size) - 1)) if len(flat) else np.zeros(0, dtype=np.uint8)
    ends = np.cumsum(size + 1) - 1
    return data, ends - size, ends, many


def merged_partitions(scan: DataFrame) -> int:
    """Partitions for ``coalesce`` so that a task has about TASK_BYTES: scan splits are merged if they are smaller."""
    raw = scan.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30}
    split = int(raw[:-1]) << units[raw[-1]] if raw[-1] in units else int(raw)
    n, merge = scan.rdd.getNumPartitions(), max(1, TASK_BYTES // max(1, split))
    return max(1, min(n, max(scan.sparkSession.sparkContext.defaultParallelism, -(-n // merge))))

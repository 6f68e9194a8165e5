"""Operator 6: approximate nearest neighbours by shifted space-filling curves.

Every curve projects the vectors on a few random orthonormal directions, shifts them at random inside a grid and orders them
along a Hilbert curve. Spark sorts the keys by ranges, which gives blocks of BLOCK neighbouring keys. A query meets its own
block and those before and after it, each in one task with exact double-precision distances on the original vectors; the best
of each block are merged over all curves and ranked.

The window on either side of a query is at least ``share`` of the vectors and at least LEAST of them. In data without structure
(directions spread evenly over many dimensions) near and far differ little, and only a window in proportion keeps the recall
as data grow; for clustered data ``share`` can be set to 0. Recall is measured against brute force in tests/llm.

Equal vectors are one node with its k + 1 smallest ids, all that any answer can use, so a vector that fills a third of the
table is searched once; queries are joined to their node at the end.

Defined results: null, zero or empty vectors, vectors with null or non-finite components, vectors not of the commonest length
and rows without id take no part; a query that takes no part has no rows; ties go to the smaller id; rows repeated whole count
once; fewer candidates than k give fewer rows; an empty table gives none; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupescope.llm.common import bounded_batches, written

CURVES, DIMENSIONS, CELL_BITS, SEED = 24, 8, 4, 7
BLOCK, SHARE, LEAST = 2048, 0.02, 512


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell coordinates (unsigned, ``bits`` bits each)."""
    x = cells.T.astype(np.int64)
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(vectors: np.ndarray, mean: np.ndarray, spread: float, curve: int, dims: int = DIMENSIONS, bits: int = CELL_BITS) -> np.ndarray:
    rng = np.random.default_rng([SEED, curve])
    d = vectors.shape[1]
    turn, _ = np.linalg.qr(rng.standard_normal((d, min(dims, d))))
    shift = rng.random(turn.shape[1])
    place = ((vectors - mean) @ turn / (8 * spread) + 0.5) / 2 + shift / 2
    return hilbert(np.clip(place * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, curves: int = CURVES, share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance) of each query's ``k`` nearest found.
    ``is_query``: a condition on the column ``id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 1
    rows = rows.where(F.size("v") == d)
    same = Window.partitionBy("v").orderBy("id")
    nodes = written(rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("node", F.col("ids")[0]), "vector-nodes")
    queries = written(rows.where(is_query).distinct().join(nodes.select("v", "node"), "v").select(F.col("id").alias("query_id"), "node"), "vector-queries")
    moments = nodes.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s")).orderBy("i").collect()  # as many rows as dimensions
    mean = np.array([r.m for r in moments], dtype=float)
    spread = float(np.sqrt(max(1e-12, np.mean([r.s for r in moments])))) if moments else 1.0
    reach = int(np.ceil(max(least, share * nodes.count()) / block))
    kind = "float" if dict(nodes.dtypes)["v"] == "array<float>" else "double"
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                some = b.slice(lo, 2048)
                v = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, d)
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                for c in range(curves):
                    yield pa.record_batch([pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(curve_keys(v.astype(np.float64), mean, spread, c)), some.column(0), some.column(2), raw], names=["curve", "key", "node", "asked", "v"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the blocks of a partition; a block holds rows of one curve."""
        part, last, number, filled = TaskContext.get().partitionId(), None, -1, 0
        for b in batches:
            numbers = np.zeros(b.num_rows, dtype=np.int32)
            for i, c in enumerate(b.column(0).to_pylist()):
                if c != last or filled == block:
                    last, number, filled = c, number + 1, 0
                numbers[i] = number
                filled += 1
            yield pa.record_batch([b.column(0), pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(numbers), *(b.column(i) for i in (2, 3, 4))], names=["curve", "part", "number", "node", "asked", "v"])

    asked = nodes.join(queries.select("node").distinct().withColumn("asked", F.lit(True)), "node", "left").select("node", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = asked.mapInArrow(keyed, "curve int, key bigint, node bigint, asked boolean, v binary").repartitionByRange(parts, "curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    blocks = written(sorted_keys.mapInArrow(blocked, "curve int, part int, number int, node bigint, asked boolean, v binary"), "vector-blocks")
    order = Window.partitionBy("curve").orderBy("part", "number")  # a row for each block
    places = blocks.select("curve", "part", "number").distinct().withColumn("place", F.row_number().over(order))
    placed = blocks.join(places, ["curve", "part", "number"]).select("curve", "place", "node", "asked", "v")
    around = F.sequence(F.col("place") - reach, F.col("place") + reach)
    asking = placed.where("asked").select(F.col("curve").alias("c"), F.explode(around).alias("p"), F.col("node").alias("query_node"), F.col("v").alias("query_v"))
    there = placed.select(F.col("curve").alias("there_c"), F.col("place").alias("there_p"), F.col("node").alias("there_node"), F.col("v").alias("there_v"))

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame({"query_node": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "distance": np.zeros(0)})
        near = np.frombuffer(b"".join(theirs["there_v"]), dtype=dtype).astype(np.float64).reshape(-1, d)
        node = theirs["there_node"].to_numpy()
        out = []
        for q, raw in zip(ours["query_node"], ours["query_v"], strict=True):
            distance = np.sqrt(((near - np.frombuffer(raw, dtype=dtype).astype(np.float64)) ** 2).sum(axis=1))
            top = np.flatnonzero(distance <= np.partition(distance, min(k, len(distance) - 1))[min(k, len(distance) - 1)])
            top = top[np.lexsort((node[top], distance[top]))][: k + 1]
            out.append(pd.DataFrame({"query_node": q, "node": node[top], "distance": distance[top]}))
        return pd.concat(out)

    met = asking.groupBy("c", "p").cogroup(there.groupBy("there_c", "there_p")).applyInPandas(best, "query_node bigint, node bigint, distance double")
    met = met.groupBy("query_node", "node").agg(F.min("distance").alias("distance"))
    first = F.row_number().over(Window.partitionBy("query_node").orderBy("distance", "node"))
    near = met.withColumn("r", first).where(F.col("r") <= k + 1).join(nodes.select("node", "ids"), "node").select("query_node", "distance", F.explode("ids").alias("id"))
    first = F.row_number().over(Window.partitionBy("query_node").orderBy("distance", "id"))
    lists = near.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("query_node").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    answers = queries.join(lists, F.col("node") == F.col("query_node")).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("r", "n")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.distance").alias("score"))

"""Ordering operators: row positions (ORD-1), positional splits (ORD-2/3),
top-n per query (ORD-4) and prefix cuts at several k (ORD-5).

Positions at scale. ``row_number() over (order by key)`` plans a single
partition, so rows are sorted by key ranges instead, at every size alike:

1. ``repartitionByRange`` + ``sortWithinPartitions`` on the order key: rows of
   one partition follow those of the partition before;
2. ``monotonically_increasing_id`` gives partition and place inside it, and a
   written table fixes both;
3. a prefix sum over the partitions' row counts (as many rows as partitions)
   is broadcast back.

The key should be unique (add a tie-breaker column): a hot value of the first
key column is then still split by the following columns. Rows of equal keys
get positions in an arbitrary but fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupescope.session import materialize

PLACE_BITS = 33  # of monotonically_increasing_id: the place inside a partition


def with_positions(df: DataFrame, order_cols: list[str], pos_col: str = "pos",
                   rowwise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ORD-1: add ``pos`` = 0..n-1 following ``order_cols``. ``rowwise``
    changes or filters the sorted rows one by one before they are numbered, so
    heavy work on them and the numbering share a shuffle and a table; it is
    done by as many tasks as the session has shuffle partitions."""
    if rowwise:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = rowwise(df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols))
    else:
        ranges = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    placed = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(pos_col, F.col("_off") + inside).drop("_place", "_part", "_off"))


def rank_within(df: DataFrame, key_cols: list[str], order_cols: list[str], out_col: str = "rank_in_key") -> DataFrame:
    """0-based rank of each row inside its key group, skew-safe.

    Positions over (key, order) spread a hot key over many partitions; the
    rank is the position minus the key's first position. Only one row per key
    is joined back (a partial min aggregate), and AQE splits a skewed key.
    """
    g = with_positions(df, key_cols + order_cols, "_gpos")
    first = g.groupBy(*key_cols).agg(F.min("_gpos").alias("_first"))
    return (
        g.join(first, key_cols)
        .withColumn(out_col, F.col("_gpos") - F.col("_first"))
        .drop("_gpos", "_first")
    )


def train_size(n: int, test_size: float) -> int:
    """ORD-2 arithmetic: ``int((1 - test_size) * n)``, double then truncation."""
    return int((1 - float(test_size)) * int(n))


def positional_split(df: DataFrame, test_size: float = 0.1, pos_col: str = "pos",
                     split_col: str = "split", total: int | None = None) -> DataFrame:
    """ORD-2/ORD-3: first ``int((1-t)*n)`` positions are train, the rest test.

    ``n`` is one count (an aggregate, usually already known from ORD-1); the
    cut is then a literal, so the filter stays a pushed-down predicate.
    """
    if total is None:
        total = df.count()
    cut = train_size(total, test_size)
    return df.withColumn(
        split_col, F.when(F.col(pos_col) < F.lit(cut), F.lit("train")).otherwise(F.lit("test"))
    )


def top_n(pairs: DataFrame, n: int, query_col: str, score_col: str, tie_col: str,
          tie_ascending: bool = True, rank_col: str = "rank") -> DataFrame:
    """ORD-4: best ``n`` rows per query; plans ``WindowGroupLimit`` before the
    shuffle, so each task forwards at most ``n`` rows per query."""
    tie = F.col(tie_col).asc() if tie_ascending else F.col(tie_col).desc()
    w = Window.partitionBy(query_col).orderBy(F.col(score_col).desc(), tie)
    return pairs.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def cut_at_ks(ranked: DataFrame, ks: list[int], rank_col: str = "rank") -> DataFrame:
    """ORD-5: one copy of each ranked row for every k with rank <= k (no join:
    the fixed k list is exploded per row)."""
    ks_arr = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    return ranked.withColumn("k", F.explode(F.filter(ks_arr, lambda k: k >= F.col(rank_col))))

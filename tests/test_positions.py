from pyspark.sql import Window
from pyspark.sql import functions as F

from dupescope.operators.positions import cut_at_ks, positional_split, rank_within, train_size, with_positions


def test_bucketed_positions_equal_global_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("g"))
    got = with_positions(df, ["g", "k"], "pos")
    want = df.withColumn("pos", F.row_number().over(Window.orderBy("g", "k")) - 1)
    assert got.select("g", "k", "pos").exceptAll(want.select("g", "k", "pos")).count() == 0
    assert got.count() == 5000


def test_rank_within_hot_key(spark):
    # one key holds most rows: ranks must still be 0..m-1 in order
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("key"),
                                     F.col("id").alias("pos"))
    got = rank_within(df, ["key"], ["pos"], "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1)
    assert got.select("key", "pos", "r").exceptAll(want.select("key", "pos", "r")).count() == 0


def test_split_worked_case(spark):
    assert train_size(7, 0.1) == 6
    df = spark.range(7).withColumnRenamed("id", "pos")
    rows = positional_split(df, 0.1).orderBy("pos").collect()
    assert [r.split for r in rows] == ["train"] * 6 + ["test"]


def test_cut_at_ks(spark):
    df = spark.createDataFrame([(1,), (3,), (6,)], "rank int")
    got = sorted((r.rank, r.k) for r in cut_at_ks(df, [1, 5]).collect())
    assert got == [(1, 1), (1, 5), (3, 5)]


def test_positions_have_no_single_task_window_over_rows(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 503).alias("k"))
    got = with_positions(df, ["k"])
    assert [r.pos for r in got.orderBy("k").collect()] == list(range(500))
    assert "row_number" not in got._jdf.queryExecution().toString()


def test_positions_of_repeated_keys_and_none(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(r.pos for r in with_positions(df, ["k"]).collect()) == [0, 1, 2, 3]
    assert with_positions(df.limit(0), ["k"]).count() == 0

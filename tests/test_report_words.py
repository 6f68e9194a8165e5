"""Reports are cleaned in batches, corpora read their rows once."""

import random
from collections import Counter

from pyspark.sql import functions as F

from dupescope.functions import text as T
from dupescope.operators import rows as R

BITS = ["word ", "a1b ", "x\fy ", "ab\fcd\fef", "(in\nside) ", "(closed) ", "[b (c)]) ", "[open ", "é", "٣rd ", "K", "İ", "Ⅷfoo ", "²", "naïve ", "日本語 ",
        "http://a.b/c?d ", "https://x.y/ü%&. ", "]http://x.y) ", ". ", "! ", "?\r", "...", "\x01", "\x00", "\x0b", "\x85", "\t", "\n", "long sentence here. ",
        "went ", "Running ", "_x ", "the ", "a_b_c ", "abcdefghijklmno ", "abcdefghijklmnop ", "word.word", "another report fails."]


def test_cleaning_in_batches_equals_the_column_form(spark):
    rnd = random.Random(8)
    texts = [None, "", "."] + ["".join(rnd.choices(BITS, k=rnd.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    got = T.with_preprocessed(df, {"new": "text", "id_too": F.col("text")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 1  # before: every sentence was decoded and searched by itself
    rows = got.withColumn("old", T.preprocess("text")).collect()
    assert [r.new for r in rows] == [r.old for r in rows] == [r.id_too for r in rows] and sum(r.new is not None for r in rows) > 500


def test_corpora_read_their_rows_once(spark, tmp_path):
    spark.createDataFrame([(["a", "b"],), (["c"],), ([],)], "tokens array<string>").write.parquet(f"{tmp_path}/reports")
    spark.createDataFrame([(["d"],)], "tokens array<string>").write.parquet(f"{tmp_path}/docs")
    reports, docs = spark.read.parquet(f"{tmp_path}/reports"), spark.read.parquet(f"{tmp_path}/docs")
    corpus = R.training_corpus(reports, docs)
    assert corpus._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2  # before: 6
    got = Counter((r.train_type, r.source, tuple(r.tokens)) for r in corpus.collect())
    lists, types = [("report", ("a", "b")), ("report", ("c",)), ("report", ())], ["TASK", "PT_TASK", "DOC_TASK", "PT_DOC_TASK"]
    assert got == Counter([(t, *x) for t in types for x in lists] + [(t, "doc", ("d",)) for t in types[2:]])
    assert {r.train_type for r in R.training_corpus(reports, None).collect()} == {"TASK", "PT_TASK"}

import random

from pyspark.sql import functions as F

from dupescope.functions import text as T
from dupescope.operators import positions as P
from dupescope.operators import rows as R
from dupescope.sources import bindings as B


def _texts():
    rnd = random.Random(5)
    bits = ["word ", "a1b ", "x\fy ", "(in\nside) ", "(closed) ", "[b (c)]) ", "[open ", "é ", "٣rd ", "K", "İ", "http://a.b/c?d ", "]http://x.y) ", ". ", "\t", "\n", "long sentence here. "]
    return ["", None] + ["".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(200)]


def test_steps_left_out_change_nothing(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "id bigint, text string")
    x = T.remove_digit_words(T.remove_urls("text"))
    x = T.remove_bracket_paren(T.remove_parens(T.remove_form_feed_words(x)))
    rows = df.select(T.remove_noise("text").alias("got"), T.flatten_whitespace(T.ascii_lower(x)).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_cluster_key_is_the_digest_of_the_letters(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "text string")
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", "")
    for r in df.select(B.cluster_key(F.col("text")).alias("got"), F.when(letters != "", F.md5(letters)).alias("want")).collect():
        assert r.got == r.want


def test_reports_are_cleaned_once_and_written_once(spark, monkeypatch):
    text = "the printer reports broken paper again today. another sentence follows here quickly."
    rows = [(i, None if i % 3 else text, text if i % 2 else None, i) for i in range(40)]
    raw = spark.createDataFrame(rows, "id bigint, summary string, description string, disc_id bigint")
    tables = []
    for module in (P, R):
        monkeypatch.setattr(module, "materialize", lambda df, f=module.materialize: tables.append(df) or f(df))
    got = R.prepare_reports(raw).select("id", "pos").orderBy("pos").collect()
    kept = [i for i, a, b, _ in rows if a or b]
    assert [tuple(r) for r in got] == [(i, p) for p, i in enumerate(kept)]
    assert len(tables) == 1  # before: the cleaned rows, then the same rows in order
    plan = R.preprocess_reports(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp_replace" in line for line in plan.split("\n"))  # before: cleaned in the filter, too
    by_text = R.prepare_reports(raw, order_cols=["summary", "id"]).orderBy("pos").collect()
    assert [r.summary is None for r in by_text] == sorted((r.summary is None for r in by_text), reverse=True)


def test_steps_are_left_out_without_a_search(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "id bigint, text string")
    plan = df.select(T.remove_noise("text").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?!)" not in plan and "translate(" not in plan  # before: every text was decoded and searched for each step
    rows = df.select("text", T.flatten_whitespace("text").alias("flat")).collect()
    assert all(r.flat == (r.text and r.text.replace("\n", " ").replace("\t", " ")) for r in rows)

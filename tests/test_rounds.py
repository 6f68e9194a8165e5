"""The grid sends its rows in rounds, and what is shuffled for a table goes with its writing."""

import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupescope import session
from dupescope.operators import pruned as P
from dupescope.operators import similarity as S
from dupescope.operators import together as G


def _reports(spark, n=150):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        tokens = rnd.choices(words, k=rnd.randint(0, 9))
        terms = sorted(set(tokens))
        rows.append((i, 500 + i, i % 9, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(4)], tokens, terms, [rnd.choice([0.25, 0.5]) for _ in terms]))
    return spark.createDataFrame(rows, "pos bigint, id bigint, disc_id bigint, vector array<double>, tokens array<string>, tf_terms array<string>, tf_weights array<double>")


RANKED = {
    "overlap": S.overlap_topk, "tfidf": S.tfidf_topk, "dense": S.dense_topk, "blend": S.blend_topk, "pruned overlap": P.pruned_overlap_topk, "pruned tfidf": P.pruned_tfidf_topk,
    "together": lambda q, h, n, cell_bytes: G.rank_together(q, h, n, {"intersection": G.intersection(), "tf_idf": G.tf_idf()}, cell_bytes).drop("query_id"),
}


@pytest.mark.parametrize("kind", sorted(RANKED))
def test_rounds_give_the_lists_of_one_grid(spark, monkeypatch, kind):
    reports = _reports(spark)
    queries = reports.where("pos >= 110").select(F.col("pos").alias("query_pos"), F.col("id").alias("query_id"), "vector", "tokens", "tf_terms", "tf_weights")
    lists = lambda cell: sorted(tuple(map(str, r)) for r in RANKED[kind](queries, reports, 6, cell_bytes=cell).withColumn("score", F.round("score", 8)).collect())
    monkeypatch.setattr(S, "CELL_BYTES", 700)
    whole = lists(1 << 20)
    sent, one = [], S.ranges
    for m in (S, G, P):
        monkeypatch.setattr(m, "ranges", lambda *a: sent.append(one(*a)) or sent[-1])
    monkeypatch.setattr(S, "ROUND_BYTES", 9000)
    assert lists(700) == whole
    assert max(len(spans) for spans, _ in sent) > 2  # before: the whole grid in one shuffle
    assert all(a < b for spans, _ in sent for a, b in filter(None, spans))


def test_a_table_leaves_no_shuffle_behind(spark):
    own = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())  # other sessions write beside them
    files = lambda: {f for d in own for f in glob.glob(f"{d}/*/shuffle_*.data")}
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("x")).repartition(4, "x")
    before, was = files(), spark.conf.get(session.DROP_SHUFFLES)
    table = session.materialize(rows.groupBy((F.col("x") % 7).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20  # executors drop the files a moment later
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before  # before: they stayed until the driver's garbage collection
    assert spark.conf.get(session.DROP_SHUFFLES) == was and table.agg(F.sum("n")).first()[0] == 20000


def test_scores_of_frequent_and_rare_terms():
    rng = np.random.default_rng(2)
    lists = [rng.choice(40, size=rng.integers(0, 9)).astype(np.int64) for _ in range(90)] + [np.array([7, 7, 3])]
    weights = [rng.random(len(x)) for x in lists]
    asked = [np.array([3, 7, 39, 1000]), np.zeros(0, np.int64), np.arange(40), np.array([7, 7])]
    gains = [rng.random(len(x)) for x in asked]
    want = lambda w, g: [[sum((gi if g else 1) * (wi if w else 1) for t, gi in zip(q, qg) for u, wi in zip(x, xw) if t == u) for x, xw in zip(lists, weights)] for q, qg in zip(asked, gains)]
    for frequent in (0, 12, 10 ** 9):  # no, some and all terms by the matrix product
        S_frequent, S.FREQUENT = S.FREQUENT, frequent
        try:
            assert np.allclose(S.Postings(lists, weights).scores(asked, gains), want(True, True), atol=1e-12)
            assert (S.Postings(lists, None).scores(asked, None) == want(False, False)).all()
        finally:
            S.FREQUENT = S_frequent


def test_best_of_long_rows_with_ties():
    rng = np.random.default_rng(3)
    scores = np.concatenate([rng.integers(0, 6, (20, 5000)) * 0.1, rng.random((20, 5000)), np.full((2, 5000), 1e9) + rng.random((2, 5000))])
    scores[3, 100:900] = np.nan
    q_pos, h_pos = rng.integers(0, 6000, 42), np.arange(5000)
    for ascending in (True, False):
        for i, top in S._best(scores, q_pos, h_pos, 25, ascending):
            own = np.round(scores[i, :min(5000, q_pos[i])], S.SCORE_DIGITS)
            order = sorted(np.flatnonzero(~np.isnan(own)).tolist(), key=lambda j: (-own[j], j if ascending else -j))[:25]
            assert sorted(top.tolist()) == sorted(order)

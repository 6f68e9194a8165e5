import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupescope.operators import similarity as S


def _history(spark, n=120):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        tokens = rnd.choices(words, k=rnd.randint(0, 8))
        terms = sorted(set(tokens))
        rows.append((i, 100 + i, 100 + i % 7, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(4)], tokens, terms, [rnd.choice([0.25, 0.5]) for _ in terms]))
    return spark.createDataFrame(rows, "pos bigint, id bigint, disc_id bigint, vector array<double>, tokens array<string>, tf_terms array<string>, tf_weights array<double>"), rows


def _queries(history, first):
    return history.filter(F.col("pos") >= first).select(F.col("pos").alias("query_pos"), F.col("id").alias("query_id"), "vector", "tokens", "tf_terms", "tf_weights")


def _unit(v):
    return np.array(v) / (np.linalg.norm(v) or 1.0)


def _scores(kind, q, c):
    if kind == "overlap":
        return float(len(set(q[4]) & set(c[4])))
    sparse = sum(w * dict(zip(c[5], c[6])).get(t, 0.0) for t, w in zip(q[5], q[6]))
    if kind == "tfidf":
        return sparse
    if kind == "dense":
        return float(np.dot(q[3], _unit(c[3])))
    return 0.7 * sparse + 0.3 * float(np.dot(_unit(q[3]), _unit(c[3])))


SCORERS = {"overlap": S.overlap_topk, "tfidf": S.tfidf_topk, "dense": S.dense_topk, "blend": lambda q, h, n, **o: S.blend_topk(q, h, n, w=0.7, **o)}


@pytest.mark.parametrize("kind", sorted(SCORERS))
@pytest.mark.parametrize("cell_bytes", [1 << 20, 600])
def test_kernel_equals_brute_force_with_ties(spark, kind, cell_bytes):
    history, rows = _history(spark)
    got = {}
    for r in SCORERS[kind](_queries(history, 0), history, 5, cell_bytes=cell_bytes).collect():
        got.setdefault(r.query_pos, []).append((r.rank, r.cand_pos, r.cand_id, round(r.score, 8)))
    sign = -1 if kind == "overlap" else 1
    for q in rows:
        best = sorted(((-round(_scores(kind, q, c), 10), sign * c[0], c) for c in rows[: q[0]]), key=lambda x: x[:2])[:5]
        want = [(i + 1, c[0], c[1], round(_scores(kind, q, c), 8) + 0.0) for i, (_, _, c) in enumerate(best)]
        assert sorted(got.get(q[0], [])) == want  # position 0 has no candidates, itself least of all


def test_cell_hands_on_n_rows_although_all_tie():
    import pandas as pd

    h = pd.DataFrame({"cand_pos": range(50), "h_vec": [[0.0]] * 50})
    q = pd.DataFrame({"query_pos": [60, 70], "q_vec": [[0.0]] * 2})
    out = S._cell(3, 1.0, 0.0, True)(h, q)
    assert out.cand_pos.tolist() == [0, 1, 2, 0, 1, 2]
    assert S._cell(3, 1.0, 0.0, False)(h, q).cand_pos.tolist() == [47, 48, 49, 47, 48, 49]


def test_plan_has_no_nested_loop_and_no_pair_shuffle(spark):
    history, _ = _history(spark, 20)
    plan = S.overlap_topk(_queries(history, 10), history, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "CoGroup" in plan


def test_rank_by_names(spark):
    history, _ = _history(spark, 30)
    q = _queries(history, 25)
    both = S.rank_by(["simple", "intersection"], q, history, 2)
    assert {r.approach for r in both.collect()} == {"simple", "intersection"} and both.count() == 20
    with pytest.raises(ValueError, match="known: intersection, simple, tf_idf"):
        S.rank_by("other", q, history, 2)


def test_lsh_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 16))
    v[200:] = v[:200] + 0.3 * rng.standard_normal((200, 16))
    rows = [(i, i, 0, x.tolist()) for i, x in enumerate(v)]
    history = spark.createDataFrame(rows, "pos bigint, id bigint, disc_id bigint, vector array<double>")
    q = history.filter("pos >= 200").select(F.col("pos").alias("query_pos"), F.col("id").alias("query_id"), "vector")
    exact = {(r.query_pos, r.cand_pos): r.score for r in S.dense_topk(q, history, 5).collect()}
    near = {(r.query_pos, r.cand_pos): r.score for r in S.lsh_dense_topk(q, history, 5).collect()}
    assert len(set(exact) & set(near)) >= 0.9 * len(exact)
    assert all(abs(exact[p] - near[p]) < 1e-9 for p in set(exact) & set(near))


def test_lsh_with_copies_in_split_buckets(spark):
    """A third of all rows are one vector; every bucket is dealt out as cells of few rows; lists equal those of whole buckets."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((150, 8)).round(1)
    v[::3] = v[0]
    history = spark.createDataFrame([(i, 10 + i, 0, x.tolist()) for i, x in enumerate(v)], "pos bigint, id bigint, disc_id bigint, vector array<double>")
    q = history.filter("pos >= 60").select(F.col("pos").alias("query_pos"), F.col("id").alias("query_id"), "vector")
    key = lambda df: sorted((r.query_pos, r.rank, r.cand_pos, r.cand_id, round(r.score, 8)) for r in df.collect())
    whole, split = key(S.lsh_dense_topk(q, history, 4, planes=3, tables=40)), key(S.lsh_dense_topk(q, history, 4, planes=3, tables=40, bucket_rows=3))
    exact = key(S.dense_topk(q, history, 4))
    assert whole == split and len(set(whole) & set(exact)) >= 0.95 * len(exact)
    assert [r[2] for r in whole if r[0] == 60] == [0, 3, 6, 9]


@pytest.mark.parametrize("kind", ["dense", "blend"])
def test_small_cells_are_sent_together(spark, monkeypatch, kind):
    history, _ = _history(spark)
    queries = _queries(history, 100)
    scorer = {"dense": S.dense_topk, "blend": S.blend_topk}[kind]
    lists = lambda **o: sorted((r.query_pos, r["rank"], r.cand_pos, round(r.score, 9)) for r in scorer(queries, history, 5, **o).collect())
    asked, made = [], S._cell
    monkeypatch.setattr(S, "_cell", lambda *a: asked.append(a[-1]) or made(*a))
    whole = lists()
    groups = []
    ceil = S.math.ceil
    monkeypatch.setattr(S.math, "ceil", lambda x: groups.append(ceil(x)) or ceil(x))
    assert lists(cell_bytes=200) == whole and asked[-1] == 200
    assert groups == [1, 1]  # before: one cell of the shuffle for each 200 bytes
    monkeypatch.setattr(S, "CELL_BYTES", 600)  # the grid that larger tables get
    assert lists(cell_bytes=600) == whole and min(groups[2:]) > 1

"""Word vectors are trained in groups; the model is a table."""

import random

import numpy as np

from dupescope.operators import skipgram
from dupescope.operators import vectors as V


def _topics(n, size, seed=1):
    rnd = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(20)] for k in range(3)]
    return [[w if rnd.random() < 0.9 else "common" for w in rnd.choices(topics[i % 3], k=size)] for i in range(n)]


def _near(rows):
    words = [w for w in rows if w != "common"]
    m = np.array([rows[w] for w in words])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = m @ m.T
    np.fill_diagonal(score, -2)
    return np.mean([words[j][:2] == w[:2] for w, j in zip(words, score.argmax(axis=1))])


def test_groups_learn_one_model(spark):
    texts = _topics(600, 60) + [["once", "seen"], [], None, ["alone", None]]
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(3)
    for group_tokens in (V.GROUP_TOKENS, 9000):  # one group, and five whose vectors are means
        trained = V.train_word2vec(df, vector_size=24, epochs=8, group_tokens=group_tokens, rounds=2)
        rows = [(r.word, r.vector) for r in trained.collect()]
        assert len(rows) == len(dict(rows)) == 64 and all(len(v) == 24 and np.isfinite(v).all() for _, v in rows)
        assert _near(dict(rows)) > 0.95
        assert sorted(trained.collect()) == sorted(trained.collect())
    assert {r.word for r in V.train_word2vec(df, vector_size=4, min_count=2, epochs=1).collect()} == set(dict(rows)) - {"once", "seen", "alone"}


def test_no_vector_passes_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    def fit(*_):
        raise AssertionError("the model is on the driver")  # before: Spark ML's Word2Vec

    monkeypatch.setattr(Word2Vec, "fit", fit)
    df = spark.createDataFrame([(t,) for t in _topics(60, 30)], "tokens array<string>")
    out = V.train_word2vec(df, vector_size=6, epochs=2, group_tokens=500)
    assert out.count() == 61 and out.dtypes == [("word", "string"), ("vector", "array<double>")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "hashpartitioning(word" in plan


def test_copies_of_one_text_stay_bounded():
    codes, text = np.tile([0, 1], 5000), np.repeat(np.arange(100), 100)
    u = skipgram.first_vectors(["a", "b"], 8, 1)
    v = np.zeros_like(u)
    skipgram.train(codes, text, u, v, np.random.default_rng(0), range(0, 5), 5)
    assert np.isfinite(u).all() and np.abs(u).max() < 20


def test_first_vectors_depend_on_the_word_alone():
    a, b = skipgram.first_vectors(["x", "naïve"], 300, 42), skipgram.first_vectors(["naïve"], 300, 42)
    assert (a[1] == b[0]).all() and np.abs(a).max() < 0.5 / 300 and abs(a.mean()) < 1e-3 / 300 * 50

"""Documents in groups: every occurrence counts, and none is sent by itself."""

import math

from pyspark.sql import functions as F

from dupescope.operators import corpus as C
from dupescope.operators import vectors as V


def _docs(spark):
    rows = [(i, ["hot"] * (i % 3) + [f"w{i % 5}", "é", f"only{i}", None][: i % 5]) for i in range(40)]
    return spark.createDataFrame(rows + [(40, []), (41, None), (42, ["unknown"])], "pos bigint, tokens array<string>")


def test_features_in_small_groups(spark):
    docs, idf = _docs(spark), {"hot": 1.5, "é": 0.5} | {f"w{i}": 2.0 + i for i in range(4)} | {f"only{i}": 3.0 for i in range(0, 40, 2)}
    table = spark.createDataFrame([(t, 1, x) for t, x in idf.items()], "term string, df bigint, idf double")
    got = {r.pos: r for r in C.tfidf_features(docs, table, group_rows=6).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        own = [t for t in d.tokens or [] if t in idf]
        weight = {t: own.count(t) * idf[t] for t in sorted(set(own))}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        assert got[d.pos].tf_terms == list(weight)
        assert all(abs(a - b / norm) < 1e-12 for a, b in zip(got[d.pos].tf_weights, weight.values(), strict=True))


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (None, ["a"])], "pos bigint, tokens array<string>")
    vectors = spark.createDataFrame([("a", [3.0]), ("b", [0.0])], "word string, vector array<double>")
    assert sorted((r.pos or 0, r.vector) for r in V.mean_vectors(docs, vectors, 1).collect()) == [(0, [0.0]), (1, [2.0]), (1, [2.0])]


def test_no_occurrence_is_sent_by_itself(spark):
    docs = _docs(spark)
    vocab = spark.createDataFrame([("hot",)], "word string")
    idf = vocab.select(F.col("word").alias("term"), F.lit(1.0).alias("idf"))
    for made in (V.mean_vectors(docs, vocab, 4, draw=lambda words: V.drawn(words, 4)), C.tfidf_features(docs, idf)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "Aggregate [_g" in plan  # before: a row, or an item of a list, for each occurrence


def test_word_overlap_sends_no_weights(spark, monkeypatch):
    """A word that weighs 1 needs no weight beside it: half the bytes of a cell."""
    from dupescope.operators import similarity as S
    docs = spark.createDataFrame([(i, i, i, [f"w{j}" for j in range(i % 7)]) for i in range(30)], "pos bigint, id bigint, disc_id bigint, tokens array<string>")
    queries = docs.where("pos >= 25").select(F.col("pos").alias("query_pos"), F.col("id").alias("query_id"), "tokens")
    sized, sent = S._sized, []
    monkeypatch.setattr(S, "_sized", lambda df, arrays: sent.append(arrays) or sized(df, arrays))
    ranked = S.overlap_topk(queries, docs, 2).collect()
    assert sent == [["h_terms"], ["q_terms"]]
    want = {q: sorted(range(q), key=lambda c: (-min(q % 7, c % 7), -c))[:2] for q in range(25, 30)}
    assert {q: [r.cand_pos for r in sorted(ranked, key=lambda r: r["rank"]) if r.query_pos == q] for q in want} == want

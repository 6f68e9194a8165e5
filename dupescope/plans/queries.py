"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Column names match the DuckDB oracle in ``dupescope.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.operators import evaluate as E
from dupescope.operators import similarity as S
from dupescope.plans.reports import KS, dense_reports


def dense_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: SuccessRate@k / MAP@k of dense similarity over embeddings."""
    reports = dense_reports(spark, sf_dir)
    return E.evaluate(reports, lambda q, h, n: S.dense_topk(q, h, n, "vector"), ["vector"], KS)


def dense_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked top-25 lists of dense similarity (JOIN-1/3/4, ORD-4)."""
    reports = dense_reports(spark, sf_dir)
    queries = E.eligible_queries(reports)
    ranked = S.dense_topk(E.query_inputs(reports, queries, ["vector"]), reports, max(KS), "vector")
    return ranked.select("query_id", "rank", "cand_id", F.round("score", 6).alias("score"))


def dense_ranked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same lists from a grid of many small cells."""
    reports = dense_reports(spark, sf_dir)
    queries = E.eligible_queries(reports)
    ranked = S.dense_topk(E.query_inputs(reports, queries, ["vector"]), reports, max(KS), "vector",
                          cell_bytes=16 << 10)
    return ranked.select("query_id", "rank", "cand_id", F.round("score", 6).alias("score"))


REGISTRY = {
    "dense_eval": dense_eval,
    "dense_ranked": dense_ranked,
    "dense_ranked_blocks": dense_ranked_blocks,
}


def _merge():
    from dupescope.plans import (corpus_queries, coverage_queries, example_queries, pair_queries, pruned_queries,
                                 sentence_queries, stream_queries, text_queries, together_queries)
    REGISTRY.update(text_queries.REGISTRY)
    REGISTRY.update(corpus_queries.REGISTRY)
    REGISTRY.update(example_queries.REGISTRY)
    REGISTRY.update(stream_queries.REGISTRY)
    REGISTRY.update(coverage_queries.REGISTRY)
    REGISTRY.update(pair_queries.REGISTRY)
    REGISTRY.update(pruned_queries.REGISTRY)
    REGISTRY.update(sentence_queries.REGISTRY)
    REGISTRY.update(together_queries.REGISTRY)


_merge()


def lsh_dense_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-8: approximate candidates (sign random projections) + exact re-rank; rows-only check, recall in the tests."""
    reports = dense_reports(spark, sf_dir)
    queries = E.eligible_queries(reports)
    ranked = S.lsh_dense_topk(E.query_inputs(reports, queries, ["vector"]), reports, max(KS), dim=64)
    return ranked.select("query_id", "rank", "cand_id", F.round("score", 6).alias("score"))


def w2v_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-2: skip-gram on the training report tokens; rows-only check."""
    from dupescope.operators.vectors import train_word2vec
    from dupescope.plans.reports import text_reports

    train = text_reports(spark, sf_dir).filter(F.col("split") == "train")
    return train_word2vec(train, vector_size=300, min_count=1, epochs=5)


REGISTRY["lsh_dense_ranked"] = lsh_dense_ranked
REGISTRY["w2v_vectors"] = w2v_vectors


def results_table_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10 / WIN-7: the metric table pivoted to ``<TRAIN_TYPE>_<metric>``
    columns (one model present: TASK = dense vectors of the embeddings)."""
    long = E.evaluate_models({"TASK": dense_reports(spark, sf_dir), "PT_TASK": None},
                             lambda q, h, n: S.dense_topk(q, h, n, "vector"), ["vector"], KS)
    return E.results_table(long, ["TASK"])


REGISTRY["results_table_dense"] = results_table_dense

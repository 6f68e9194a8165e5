"""Prequential evaluation (WIN-1..9, AGG-9..11).

``reports`` carries ``id, disc_id, pos, split`` (+ representation columns).
The original walks the test rows in order, ranks the history, then appends
the row. Here the order dependence is a predicate (``cand.pos < query.pos``),
so all queries are scored in one distributed job.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupescope.operators.positions import cut_at_ks, rank_within
from dupescope.session import materialize

DEFAULT_KS = [1, 5, 10, 15, 20, 25]

Scorer = Callable[[DataFrame, DataFrame, int], DataFrame]


def eligible_queries(reports: DataFrame) -> DataFrame:
    """WIN-1 + WIN-2.

    relevant(row) = train rows of its cluster + earlier test rows of the
    cluster (originals included); repeated ids add up (counter keyed by id).
    Eligible: ``id <> disc_id`` and relevant > 0. Every test row still enters
    the history (that is the scorers' ``pos`` predicate).
    """
    train_counts = (
        reports.filter(F.col("split") == "train").groupBy("disc_id").agg(F.count(F.lit(1)).alias("_train_cnt"))
    )
    test = reports.filter(F.col("split") == "test").select("id", "disc_id", "pos")
    ranked = rank_within(test, ["disc_id"], ["pos"], "_earlier")
    per_row = ranked.join(train_counts, "disc_id", "left").withColumn(
        "_rel_row", F.coalesce(F.col("_train_cnt"), F.lit(0)) + F.col("_earlier")
    )
    per_id = per_row.groupBy("id").agg(F.sum("_rel_row").alias("relevant"))
    return (
        per_row.join(per_id, "id")
        .filter((F.col("id") != F.col("disc_id")) & (F.col("relevant") > 0))
        .select(
            F.col("pos").alias("query_pos"), F.col("id").alias("query_id"),
            F.col("disc_id").alias("query_disc"), F.col("relevant").cast("bigint").alias("relevant"),
        )
    )


def query_inputs(reports: DataFrame, queries: DataFrame, cols: list[str]) -> DataFrame:
    """Attach representation columns of the query rows (equi join on pos)."""
    rep = reports.select(F.col("pos").alias("query_pos"), *cols)
    return queries.join(rep, "query_pos")


def per_query_metrics(queries: DataFrame, ranked: DataFrame, ks: list[int]) -> DataFrame:
    """WIN-3..5: success and AP per (query, k); queries with no hits get 0."""
    hits = ranked.join(queries.select("query_pos", "query_disc"), "query_pos").withColumn(
        "hit", (F.col("cand_disc") == F.col("query_disc")).cast("int")
    )
    w = Window.partitionBy("query_pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_cum", F.sum("hit").over(w)).withColumn(
        "_prec", F.when(F.col("hit") == 1, F.col("_cum") / F.col("rank")).otherwise(F.lit(0.0))
    )
    per_qk = cut_at_ks(hits, ks).groupBy("query_pos", "k").agg(
        F.max("hit").alias("_succ"), F.sum("_prec").alias("_sum_prec")
    )
    ks_arr = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    base = queries.select("query_pos", "relevant", F.explode(ks_arr).alias("k"))
    return base.join(per_qk, ["query_pos", "k"], "left").select(
        "query_pos", "k",
        F.coalesce(F.col("_succ"), F.lit(0)).cast("double").alias("success"),
        (F.coalesce(F.col("_sum_prec"), F.lit(0.0)) / F.least(F.col("k"), F.col("relevant"))).alias("ap"),
    )


def aggregate_metrics(per_query: DataFrame, ks: list[int], digits: int = 6) -> DataFrame:
    """AGG-9: mean success / AP over eligible queries per k; null when none."""
    spark = per_query.sparkSession
    agg = per_query.groupBy("k").agg(
        F.avg("success").alias("success_rate"), F.avg("ap").alias("map"), F.count(F.lit(1)).alias("n_queries")
    )
    ks_df = spark.createDataFrame([(int(k),) for k in sorted(set(ks))], "k int")  # the k parameter list
    return ks_df.join(F.broadcast(agg), "k", "left").select(
        "k",
        F.round("success_rate", digits).alias("success_rate"),
        F.round("map", digits).alias("map"),
        F.coalesce(F.col("n_queries"), F.lit(0)).cast("bigint").alias("n_queries"),
    )


def evaluate(reports: DataFrame, scorer: Scorer, query_cols: list[str], ks: list[int] = DEFAULT_KS,
             ranked_out: list | None = None) -> DataFrame:
    """WIN-6: split-aware prequential evaluation with one scorer.

    ``scorer(queries, history, n)`` returns ranked candidates (UDF-2).
    """
    n = max(ks)
    queries = materialize(eligible_queries(reports))  # read by the scorer, the hits and the means
    q_in = query_inputs(reports, queries, query_cols)
    ranked = scorer(q_in, reports, n)
    if ranked_out is not None:
        ranked_out.append(ranked)
    return aggregate_metrics(per_query_metrics(queries, ranked, ks), ks)


def evaluate_models(reports_by_model: dict[str, DataFrame], scorer: Scorer, query_cols: list[str],
                    ks: list[int] = DEFAULT_KS) -> DataFrame:
    """WIN-7: one metric table per model (absent models skipped), long form
    ``(model, k, success_rate, map, n_queries)``."""
    out = None
    for model, reps in reports_by_model.items():
        if reps is None:
            continue
        m = evaluate(reps, scorer, query_cols, ks).withColumn("model", F.lit(model))
        out = m if out is None else out.unionByName(m)
    return out


def results_table(long_metrics: DataFrame, models: list[str]) -> DataFrame:
    """AGG-10: one row per k, columns ``<MODEL>_SuccessRate@k`` / ``<MODEL>_MAP@k``."""
    sr = long_metrics.groupBy("k").pivot("model", models).agg(F.first("success_rate"))
    mp = long_metrics.groupBy("k").pivot("model", models).agg(F.first("map"))
    sr = sr.select("k", *[F.col(f"`{m}`").alias(f"{m}_SuccessRate@k") for m in models])
    mp = mp.select("k", *[F.col(f"`{m}`").alias(f"{m}_MAP@k") for m in models])
    return sr.join(mp, "k")


def task_label(train_type: str, task: str) -> str:
    """AGG-11 naming: ``DOC(<task>)_TASK`` / ``PT_DOC(<task>)_TASK``."""
    if train_type == "DOC_TASK":
        return f"DOC({task})_TASK"
    if train_type == "PT_DOC_TASK":
        return f"PT_DOC({task})_TASK"
    return train_type


def tasks_table(long_metrics: DataFrame, tasks: list[str]) -> DataFrame:
    """AGG-11: rows carry ``model`` (train type) and ``task``; docs-trained
    models are renamed per task, the others have one value per k whatever the
    task (of differing ones the first task's counts), then pivoted like AGG-10."""
    label = (
        F.when(F.col("model") == "DOC_TASK", F.format_string("DOC(%s)_TASK", F.col("task")))
        .when(F.col("model") == "PT_DOC_TASK", F.format_string("PT_DOC(%s)_TASK", F.col("task")))
        .otherwise(F.col("model"))
    )
    labelled = long_metrics.withColumn("model", label).groupBy("model", "k").agg(
        F.min_by("success_rate", "task").alias("success_rate"), F.min_by("map", "task").alias("map"))
    labels = [task_label(m, t) for t in tasks for m in ("DOC_TASK", "PT_DOC_TASK")]
    return results_table(labelled, ["TASK", "PT_TASK"] + labels)


def task_tables(long_metrics: DataFrame, tasks: list[str]) -> dict[str, DataFrame]:
    """AGG-11: one table per task, with that task's own models."""
    return {t: results_table(long_metrics.where(F.col("task") == t), ["TASK", "PT_TASK", "DOC_TASK", "PT_DOC_TASK"])
            for t in tasks}


def relevant_counts(queries: DataFrame, train: DataFrame) -> DataFrame:
    """JOIN-10: (query_pos, query_disc, n_rel), the number of train reports in
    the query's cluster; a query without any has no row (WIN-8 leaves it out).
    A relevance set is a cluster, so it is named by ``disc_id`` and counted
    once per cluster; its (query, report) pairs are never listed."""
    sizes = train.groupBy("disc_id").agg(F.count(F.lit(1)).alias("n_rel"))
    own = queries.select("query_pos", "query_disc")
    return own.join(sizes, own["query_disc"] == sizes["disc_id"]).select("query_pos", "query_disc", "n_rel")


# ---------------------------------------------------------------- WIN-8 / WIN-9
def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int], mrr_k: int = 10,
               ndcg_k: int = 10) -> DataFrame:
    """WIN-8: fixed-corpus IR metrics over ranked lists.

    ``ranked(query_pos, rank, cand_disc)``; ``relevant(query_pos, query_disc,
    n_rel)`` (JOIN-10): a candidate is a hit if it is of the query's cluster.
    Queries without relevant documents are excluded. Returns one row per k:
    accuracy, precision, recall, MAP (normalised by min(k, n_rel)), plus
    MRR@mrr_k and NDCG@ndcg_k as columns.
    """
    n_rel = relevant.select("query_pos", "n_rel")
    hits = ranked.join(relevant, "query_pos").withColumn("hit", (F.col("cand_disc") == F.col("query_disc")).cast("int"))
    w = Window.partitionBy("query_pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_cum", F.sum("hit").over(w))
    cut = cut_at_ks(hits, ks)
    per = cut.groupBy("query_pos", "k", "n_rel").agg(
        F.max("hit").alias("acc"),
        F.sum("hit").alias("n_hit"),
        F.sum(F.when(F.col("hit") == 1, F.col("_cum") / F.col("rank")).otherwise(0.0)).alias("sum_prec"),
    )
    queries = n_rel.select("query_pos", "n_rel", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    per = queries.join(per.drop("n_rel"), ["query_pos", "k"], "left").fillna(0, ["acc", "n_hit", "sum_prec"])
    first_hit = hits.filter("hit = 1").groupBy("query_pos").agg(F.min("rank").alias("_first"))
    dcg = hits.filter((F.col("hit") == 1) & (F.col("rank") <= ndcg_k)).groupBy("query_pos").agg(
        F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("_dcg")
    )
    idcg = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(ndcg_k)).cast("int")), F.lit(0.0),
                       lambda acc, i: acc + 1.0 / F.log2(i + 1))
    q_stats = (
        n_rel.join(first_hit, "query_pos", "left").join(dcg, "query_pos", "left")
        .select(
            "query_pos",
            F.when(F.col("_first") <= mrr_k, 1.0 / F.col("_first")).otherwise(0.0).alias("_rr"),
            (F.coalesce(F.col("_dcg"), F.lit(0.0)) / idcg).alias("_ndcg"),
        )
    )
    return per.join(q_stats, "query_pos").groupBy("k").agg(
        F.avg("acc").alias("accuracy"),
        F.avg(F.col("n_hit") / F.col("k")).alias("precision"),
        F.avg(F.col("n_hit") / F.col("n_rel")).alias("recall"),
        F.avg(F.col("sum_prec") / F.least(F.col("k"), F.col("n_rel"))).alias("map"),
        F.avg("_rr").alias("mrr"),
        F.avg("_ndcg").alias("ndcg"),
    )


def best_run(runs: DataFrame, metric_col: str = "map", run_col: str = "run") -> DataFrame:
    """WIN-9: the run with the highest metric, of equal ones the first by name; runs without the metric take no part."""
    known = runs.where(F.col(metric_col).isNotNull())
    best = known.agg(F.min(F.struct((-F.col(metric_col)).alias("less"), F.col(run_col).alias("run"))).alias("b"))
    return best.select(F.col("b.run").alias(run_col), (-F.col("b.less")).alias(metric_col))

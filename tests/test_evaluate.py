from pyspark.sql import functions as F

from dupescope.operators import evaluate as E


def _reports(spark):
    rows = [(1, 1, 0, "train"), (2, 2, 1, "train"), (3, 1, 2, "train"),
            (4, 1, 3, "test"), (5, 5, 4, "test"), (6, 5, 5, "test")]
    return spark.createDataFrame(rows, "id bigint, disc_id bigint, pos bigint, split string")


def test_relevance_and_eligibility(spark):
    q = {r.query_id: r.relevant for r in E.eligible_queries(_reports(spark)).collect()}
    assert q == {4: 2, 6: 1}


def test_prequential_worked_case(spark):
    reports = _reports(spark)
    queries = E.eligible_queries(reports)
    ranked = spark.createDataFrame(
        [(3, 1, 2), (3, 2, 1), (3, 3, 1), (5, 1, 5)], "query_pos bigint, rank int, cand_disc bigint")
    m = {r.k: r for r in E.aggregate_metrics(E.per_query_metrics(queries, ranked, [1, 5]), [1, 5]).collect()}
    assert m[1].success_rate == 0.5 and m[1].map == 0.5
    assert m[5].success_rate == 1.0 and abs(m[5].map - 0.791667) < 1e-6
    assert m[5].n_queries == 2


def test_no_eligible_query_gives_null(spark):
    rows = [(1, 1, 0, "train"), (2, 2, 1, "test")]
    reports = spark.createDataFrame(rows, "id bigint, disc_id bigint, pos bigint, split string")
    out = E.evaluate(reports, lambda q, h, n: q.select("query_pos", F.lit(1).alias("rank"),
                                                       F.col("query_disc").alias("cand_disc")), [], [1])
    r = out.first()
    assert r.success_rate is None and r.map is None and r.n_queries == 0


def test_tables_by_task(spark):
    rows = [("TASK", "mlm", 1, 0.5, 0.4), ("TASK", "nsp", 1, 0.6, 0.7), ("DOC_TASK", "mlm", 1, 0.1, 0.2), ("DOC_TASK", "nsp", 1, 0.3, 0.9)]
    long = spark.createDataFrame(rows, "model string, task string, k int, success_rate double, map double")
    r = E.tasks_table(long, ["mlm", "nsp"]).first().asDict()
    assert (r["TASK_MAP@k"], r["DOC(mlm)_TASK_MAP@k"], r["DOC(nsp)_TASK_MAP@k"], r["PT_DOC(mlm)_TASK_MAP@k"]) == (0.4, 0.2, 0.9, None)
    own = E.task_tables(long, ["mlm", "nsp"])
    assert own["nsp"].first()["TASK_MAP@k"] == 0.7 and own["mlm"].first()["DOC_TASK_MAP@k"] == 0.2


def test_relevance_sets_and_ir_metrics(spark):
    train = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "pos bigint, disc_id bigint")
    queries = spark.createDataFrame([(10, 1), (11, 2), (12, 9)], "query_pos bigint, query_disc bigint")
    relevant = E.relevant_counts(queries, train)
    assert sorted(map(tuple, relevant.collect())) == [(10, 1, 2), (11, 2, 1)]
    ranked = spark.createDataFrame([(10, 1, 2), (10, 2, 0), (11, 1, 2), (12, 1, 0)], "query_pos bigint, rank int, cand_pos bigint")
    ranked = ranked.join(train.select(F.col("pos").alias("cand_pos"), F.col("disc_id").alias("cand_disc")), "cand_pos")
    m = {r.k: r for r in E.ir_metrics(ranked, relevant, [1, 2]).collect()}  # query 12 has no relevant report and is left out
    assert (m[1].accuracy, m[1].precision, m[1].recall) == (0.5, 0.5, 0.5)
    assert (m[2].accuracy, m[2].precision, m[2].recall) == (1.0, 0.5, 0.75)
    assert abs(m[2].map - (0.5 / 2 + 1) / 2) < 1e-12 and m[2].mrr == 0.75


def test_best_run_of_equal_ones_is_the_first_by_name(spark):
    runs = spark.createDataFrame([("c", 0.5), ("b", 0.7), ("a", 0.7), ("z", None)], "run string, map double")
    assert tuple(E.best_run(runs).first()) == ("a", 0.7) and tuple(E.best_run(runs.where("run = 'z'")).first()) == (None, None)


def test_shared_checkpoint_folder_is_asked_for(monkeypatch):
    import pytest

    from dupescope import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())

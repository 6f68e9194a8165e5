"""Word vectors are not sent about, and their files are packed."""

import os

from pyspark.sql import functions as F

from dupescope.operators import vectors as V
from dupescope.plans import coverage_queries as Q


def _documents(spark, tmp_path):
    texts = [(i, f"Report number{i}\n{'The printer stopped working because paper jammed. ' * 3}Odd{chr(97 + i)}word fails here again.") for i in range(20)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_overlay_sorts_no_shuffled_vector(spark, tmp_path):
    out = Q.overlay_vectors(spark, _documents(spark, tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # before: the drawn vectors of both sides were dealt and sorted for a join
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange") == 2  # of the words
    got = {r.word: (r.n, r.first) for r in out.collect()}
    for word, (n, first) in got.items():
        seed = 7 if "e" in word else 42
        assert n == 300 and first == int(V.drawn([word], 1, seed)[0, 0] * 2 ** 32)
    assert "printer" in got and "stopped" in got


def test_digest_of_negative_and_uneven_vectors(spark):
    df = spark.createDataFrame([("a", [-0.25, 0.5, 1.0]), ("b", [0.75])], "word string, vector array<double>")
    got = {r.word: (r.n, r.first, r.checksum) for r in Q._digest(df, "word", bits=1).collect()}
    assert got == {"a": (3, -1, -1 + 2 * 1 + 3 * 2), "b": (1, 1, 1)}


def test_vector_files_are_packed(spark, tmp_path, monkeypatch):
    paths = {}
    monkeypatch.setattr(Q, "_scratch", lambda _, name: paths.setdefault(name, f"{tmp_path}/{name}"))
    out = Q.vector_files(spark, _documents(spark, tmp_path))
    kinds = {}
    for r in out.collect():
        kinds.setdefault(r.kind, {})[r.word] = (r.n, r.checksum)
    assert kinds["json"] == kinds["parquet"] and set(kinds["text"]) == set(kinds["json"])
    size = {k: sum(os.path.getsize(f"{p}/{f}") for f in os.listdir(p) if f.startswith("part-")) for k, p in paths.items()}
    plain = len(kinds["json"]) * 300 * 18
    assert size["vec-text"] < 0.6 * plain and size["vec-json"] < 0.6 * plain and size["vec-parquet"] < 0.8 * len(kinds["json"]) * 300 * 8


def test_overlay_settled_on_words(spark):
    own, pre = (spark.createDataFrame([(w,) for w in words], "word string") for words in (["a", "b", "b", None], ["b", "c", None]))
    draw = lambda d: V.random_vectors(d, 3), lambda d: V.random_vectors(d, 3, seed=7)
    key = lambda df: sorted(((r.word or ""), r.vector) for r in df.collect())
    assert key(V.overlay_pretrained(own, pre, draw)) == key(V.overlay_pretrained(draw[0](own), draw[1](pre)))


def test_unseen_words_send_no_train_vector(spark):
    words = ["printer", "printing", "reprint", "jam", "jam", "jammed", None, "a", "zzz"]
    train = spark.createDataFrame([(w,) for w in words], "word string")
    asked = spark.createDataFrame([(w,) for w in ("printed", "jams", "qqq", "zz", None)], "word string")
    plain = V.subword_vectors(V.random_vectors(train, 6))
    drawn = V.subword_vectors(train, dim=6, draw=lambda w: V.drawn(w, 6))
    wanted = V.subword_vectors(train, dim=6, draw=lambda w: V.drawn(w, 6), wanted=V.word_grams(asked))
    rows = lambda df, k: {r[k]: [round(x, 9) for x in r.vector] for r in df.collect()}
    want = rows(plain, "gram")
    assert rows(drawn, "gram") == want and len(want) > 50
    some = {r.gram for r in V.word_grams(asked).collect()}
    assert rows(wanted, "gram") == {g: v for g, v in want.items() if g in some}
    got = rows(V.oov_vectors(asked, wanted), "word")
    assert got == rows(V.oov_vectors(asked, plain), "word") and set(got) == {"printed", "jams", "zz"}
    known = [want[g] for g in sorted({r.gram for r in V.word_grams(asked).where("word = 'jams'").collect()}) if g in want]
    assert all(abs(a - sum(b) / len(known)) < 1e-6 for a, b in zip(got["jams"], zip(*known)))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "vector_to_array" not in plan and "array_to_vector" not in plan  # before: each n-gram carried its word's vector

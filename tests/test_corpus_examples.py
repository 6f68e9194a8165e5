import math

from pyspark.sql import functions as F

from dupescope.operators import corpus as C
from dupescope.operators import vectors as V
from dupescope.operators.examples import randint_except


def test_idf_worked_case(spark):
    train = spark.createDataFrame([(0, ["aa", "bb"]), (1, ["aa", "cc"]), (2, ["aa"])], "pos bigint, tokens array<string>")
    idf = {r.term: r.idf for r in C.idf_table(train).collect()}
    assert abs(idf["aa"] - 1.0) < 1e-12
    assert abs(idf["bb"] - (math.log(2) + 1)) < 1e-12 and abs(idf["cc"] - 1.693147) < 1e-6


def test_mean_vector_worked_case(spark):
    docs = spark.createDataFrame([(0, ["x", "x", "y", "z"]), (1, ["z"])], "pos bigint, tokens array<string>")
    vecs = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "word string, vector array<double>")
    got = {r.pos: r.vector for r in V.mean_vectors(docs, vecs, 2).collect()}
    assert abs(got[0][0] - 2 / 3) < 1e-12 and abs(got[0][1] - 1 / 3) < 1e-12
    assert got[1] == [0.0, 0.0]


def test_randint_except_worked_case(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "d bigint")
    got = [r[0] for r in df.select(randint_except(F.lit(0), F.lit(5), F.array(F.lit(1), F.lit(3)), F.col("d")))
           .orderBy(F.col("d")).collect()]
    assert sorted(got) == [0, 2, 4]


def test_cluster_pair_counts(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (9, 3)], "disc_id bigint, pos bigint")
    got = {r.disc_id: (r.n_pos_pairs, r.n_triplets) for r in C.cluster_summary(df).collect()}
    assert got == {1: (3, 6), 9: (0, 0)}


def test_mean_vectors_with_a_hot_word(spark):
    rows = [(i, ["hot"] * (1 + i % 3) + ([f"w{i}"] if i % 2 else [])) for i in range(300)]  # one word in two thirds of the pairs
    docs = spark.createDataFrame(rows, "pos bigint, tokens array<string>")
    vecs = spark.createDataFrame([("hot", [1.0, 0.0])] + [(f"w{i}", [0.0, float(i)]) for i in range(300)], "word string, vector array<double>")
    for r in V.mean_vectors(docs, vecs, 2).collect():
        n = len(r.tokens)
        want = [r.tokens.count("hot") / n, (float(r.pos) if r.pos % 2 else 0.0) / n]
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.vector, want))


def test_masked_mean_with_all_masked(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "doc int, vector array<double>, mask int")
    assert {r.doc: r.vector for r in V.masked_mean_pool(df).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_short_words_have_no_backward_grams(spark):
    df = spark.createDataFrame([("ab",)], "word string")
    assert sorted(df.select(V._ngrams(F.concat(F.lit("<"), F.col("word"), F.lit(">")), 3, 6)).first()[0]) == ["<ab", "<ab>", "ab>"]


def test_lemmas(spark):
    from dupescope.operators import lemmas as L

    words = "crash crashed crashes crashing use used studies study bring bringing thing went class red ed".split()
    table = L.lemma_table(spark.createDataFrame([(w,) for w in words], "word string"))
    got = {r.word: r.lemma for r in table.collect()}
    assert got == {"crashed": "crash", "crashes": "crash", "crashing": "crash", "used": "use", "studies": "study",
                   "bringing": "bring", "went": "go"}
    docs = spark.createDataFrame([(0, ["crashed", "red", "crashed"]), (1, []), (2, ["thing"])], "pos bigint, tokens array<string>")
    done = {r.pos: r.tokens for r in L.apply_lemmas(docs, table).collect()}
    assert done == {0: ["crash", "red", "crash"], 1: [], 2: ["thing"]}


def test_rank_within_third_of_rows_in_one_section(spark):
    from dupescope.operators import examples as X

    rows = [(0 if i % 3 == 0 else i, i, [f"t{i}", "a", "b"]) for i in range(120)]
    s = X.doc_sentences(spark.createDataFrame(rows, "section_id bigint, sent_idx bigint, tokens array<string>"))
    hot = sorted((r.idx_in_section, r.sentence) for r in s.where("section_id = 0").collect())
    assert [i for i, _ in hot] == list(range(40)) and hot[1][1].startswith("t3 ")


def test_builders_by_name(spark):
    import pytest

    from dupescope.operators import examples as X

    s = X.doc_sentences(spark.createDataFrame([(i // 5, i, ["a", f"t{i}", "b"]) for i in range(20)], "section_id bigint, sent_idx bigint, tokens array<string>"))
    assert X.build_examples("tsdae", s).count() == 20 and X.build_examples("mlm", s).count() == 20
    assert X.build_examples("sts", s).where("label = 1.0").count() == 19
    with pytest.raises(ValueError, match="known: mlm, nsp, sase, sts, tsdae"):
        X.build_examples("other", s)


def test_mean_vectors_drawn_in_their_groups(spark):
    rows = [(i, [f"w{i % 7}", "hot", f"w{i}"] * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "pos bigint, tokens array<string>")
    vocab = spark.createDataFrame([("hot",)] + [(f"w{i}",) for i in range(0, 60, 2)], "word string")
    stored = {r.word: r.vector for r in V.random_vectors(vocab, 6).collect()}
    for opts in ({}, {"group_rows": 7}, {"group_rows": 7, "draw": lambda words: V.drawn(words, 6)}):
        vectors = vocab if "draw" in opts else V.random_vectors(vocab, 6)
        for r in V.mean_vectors(docs, vectors, 6, **opts).collect():
            own = [stored[w] for w in r.tokens if w in stored]
            want = [sum(x) / len(own) for x in zip(*own)] if own else [0.0] * 6
            assert all(abs(a - b) < 1e-12 for a, b in zip(r.vector, want))


def test_drawn_vectors_are_the_hash_draws(spark):
    from dupescope.functions.hashing import four_draws
    words = spark.createDataFrame([("plain",), ("naïve",), ("",), (None,)], "word string")
    draws = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda g: four_draws(F.col("word"), g, seed=7)))
    want = {r.word: r.d[:10] for r in words.select("word", draws.alias("d")).collect()}
    got = V.drawn(list(want), 10, seed=7)
    assert {w: list(v) for w, v in zip(want, got)} == want
    assert (V.drawn(["plain"], 10, seed=7, centred=True) == (got[list(want).index("plain")] - 0.5) / 10).all()

from pyspark.sql import functions as F

from dupescope.functions import text as T

NOISE_CASES = [
    ("See https://a.b/c?d=1 for v2 (beta) NPE\tin Foo\nBar [x] ok", "see  for     npe in foo bar [x] ok"),
    ("ftp://host/x crashed", "ftp crashed"),
    ("keep [a] and [b]) end", "keep   end"),
    ("café “quoted” naïve", "caf quoted nave"),
    ("a(b\nc)d", "a(b c)d"),
    ("ab\fcd tail", "  tail"),
    ("a\fb\fc tail", "   tail"),
    ("x \f\f y\f z", "x      z"),
]


def test_remove_noise_worked_cases(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NOISE_CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.remove_noise(F.col("t")).alias("c")).collect()}
    for i, (_, want) in enumerate(NOISE_CASES):
        assert got[i] == want, (NOISE_CASES[i][0], got[i], want)


def test_sentence_filter_and_null(spark):
    df = spark.createDataFrame([([["a1", "a2", "a3"], ["b1", "b2"]],), ([["b1", "b2"]],)],
                               "s array<array<string>>")
    got = [r[0] for r in df.select(T.keep_long_sentences(F.col("s"))).collect()]
    assert got == [[["a1", "a2", "a3"]], None]


def test_tokenize_rules(spark):
    df = spark.createDataFrame([("ab abc _abc abcdefghijklmnop foo_bar x9y done went using",)], "t string")
    toks = df.select(T.tokenize(F.col("t"))).first()[0]
    assert toks == ["abc", "foo_bar", "done", "went", "using"]
    norm = df.select(T.lemmatize(T.remove_stop_words(T.tokenize(F.col("t"))))).first()[0]
    assert norm == ["abc", "foo_bar", "do", "go", "using"]


def test_preprocess_column_and_sql_forms_agree(spark):
    texts = [("The build failed again. It crashed when opening files!",), (None,), ("a b.",),
             ("Compiler went wrong and wrote broken output files quickly.",)]
    df = spark.createDataFrame(texts, "t string")
    a = [r[0] for r in df.select(T.preprocess(F.col("t"))).collect()]
    b = [r[0] for r in T.with_preprocessed(df, {"p": F.col("t")}).select("p").collect()]
    assert a == b
    assert a[1] is None and a[2] is None
    assert a[3] == [["compiler", "go", "wrong", "write", "break", "output", "files", "quickly"]]

"""Operator 7: quality rules and a hashed n-gram log-likelihood ratio, with Spark expressions alone.

Base rules count words, characters, symbols, repeated lines and repeated five-word windows of each text. The method's verdict
compares two multinomials over hashed word n-grams (``ngrams`` of 1 and 2 words in ``buckets`` buckets): that of trusted
documents and that of the whole corpus. A document's score is its mean log ratio over its n-grams; it is kept if the score is
at least ``threshold``, without any draw.

The corpus counts cover every document (partial sums per task, then at most ``buckets`` rows are shuffled). The trusted side is
fitted on labelled rows, at most about ``trusted_limit`` of them, picked by a hash of the id, so the set of their ids that is
broadcast is bounded; so is the model, with ``buckets`` rows at most. No text is shuffled.

Defined results: a null text has no words, fails the base rules and has no score (null); a null label is not trusted; documents
without trusted ones at all get a ratio against a uniform target; repeated rows each get their row; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupescope.llm.common import let

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS, ALPHA = 1 << 13, 1.0
#: Labelled documents that the trusted multinomial is fitted on, about.
TRUSTED_LIMIT = 200_000
THRESHOLD = -0.08


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _window(ws: Column, i: Column, size: int) -> list[Column]:
    return [F.get(ws, i + k) for k in range(size)]


def _covered(places: Column, size: int) -> Column:
    """Words in windows of ``size`` words that begin at ascending places."""
    steps = F.transform(places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(size)), F.lit(size)).cast("bigint"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _repeat_words_exact(ws: Column, size: int) -> Column:
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.struct(F.concat_ws(" ", *_window(ws, i, size)).alias("w"), i.alias("i")))

    def places(s: Column) -> Column:
        again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]))
        return F.sort_array(F.array_compact(again))

    return let(let(F.sort_array(windows), places), lambda p: _covered(p, size))


def repeat_words(ws: Column, size: int = 5) -> Column:
    """Words in ``size``-word windows found twice or more. Hashes of the windows (the last few are shorter) tell texts without
    any repeat; the others are counted on the windows themselves."""
    hashes = F.transform(ws, lambda x, i: F.xxhash64(x, *_window(ws, i + 1, size - 1)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(ws) > size) & repeats, _repeat_words_exact(ws, size)).otherwise(F.lit(0)).cast("bigint")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def base_columns(text: Column, ws: Column) -> dict[str, Column]:
    """n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words."""
    return {
        "n_words": F.size(ws).cast("bigint"),
        "word_chars": F.length(F.array_join(ws, "")).cast("bigint"),
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(ws),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ngram_buckets(ws: Column, buckets: int) -> Column:
    one = F.transform(ws, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(ws, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Ids of at most about ``limit`` documents labelled of quality and not toxic, picked by a hash of the id."""
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0) & F.col("id").isNotNull()).select("id")
    rate = good.agg(F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(F.count("*"), F.lit(1)))).scalar()
    return good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20))


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """``bucket`` and ``ratio``: log of trusted share over corpus share, for each bucket in use. ``trusted``: a bounded table of ids."""
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(trusted.select(F.col("id"), F.lit(1).alias("trusted")).distinct()), "id", "left")
    grams = flagged.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words(F.col("text")).alias("ws")).select("trusted", F.explode(ngram_buckets(F.col("ws"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("every"), F.sum("trusted").alias("good"))
    all_buckets = Window.partitionBy()  # as many rows as buckets, at most
    share = lambda c: F.log((F.col(c) + alpha) / (F.sum(c).over(all_buckets) + alpha * buckets))
    return counts.select("bucket", (share("good") - share("every")).alias("ratio"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: the id column, the base counts, ``base_failed``, ``score`` and ``kept``."""
    model = ratios(docs, trusted_ids(labels), id_col, text_col, buckets)
    split = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), words(F.col(text_col)).alias("_words"))
    base = base_columns(F.col("_text"), F.col("_words"))
    counted = split.select("_row", "_id", *(c.alias(n) for n, c in base.items()), ngram_buckets(F.col("_words"), buckets).alias("_grams"))
    grams = counted.select("_row", "_id", *base, F.explode_outer("_grams").alias("bucket"))  # a step of its own: else the counts are made anew for each n-gram
    scored = grams.join(F.broadcast(model), "bucket", "left").groupBy("_row").agg(F.first("_id").alias(id_col), *(F.first(n).alias(n) for n in base), F.avg("ratio").alias("score")).drop("_row")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))

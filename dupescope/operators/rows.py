"""Row-level operators (ROW-1..10) and set operators (SET-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupescope.functions import text as T
from dupescope.functions.hashing import h
from dupescope.operators.positions import positional_split, with_positions
from dupescope.session import materialize


def preprocess_reports(raw: DataFrame) -> DataFrame:
    """ROW-1 + ROW-2: clean both text fields (null stays null) and keep a
    report when either field survives."""
    out = T.with_preprocessed(raw, {"summary": F.col("summary"), "description": F.col("description")})
    # numbered rows keep the filter above the cleaning: pushed below, it would clean every text a second time
    numbered = out.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter((F.col("_row") >= 0) & (F.col("summary").isNotNull() | F.col("description").isNotNull())).drop("_row")


def report_tokens(summary="summary", description="description"):
    """ROW-3: summary sentences then description sentences, flattened."""
    empty = F.array().cast("array<array<string>>")
    return F.flatten(F.concat(F.coalesce(F.col(summary), empty), F.coalesce(F.col(description), empty)))


def report_sentences(df: DataFrame, key: str = "pos") -> DataFrame:
    """ROW-4: one row per sentence, in order (report key, sent_idx, tokens)."""
    empty = F.array().cast("array<array<string>>")
    sents = F.concat(F.coalesce(F.col("summary"), empty), F.coalesce(F.col("description"), empty))
    return df.select(key, F.posexplode(sents).alias("sent_idx", "tokens"))


def flatten_once(col):
    """ROW-5."""
    return F.flatten(F.col(col) if isinstance(col, str) else col)


def prepare_reports(raw: DataFrame, test_size: float = 0.1, order_cols: list[str] | None = None) -> DataFrame:
    """L1 pipeline: ROW-1/2 -> ORD-1 -> ORD-2 -> ROW-3. Rows are cleaned where
    ORD-1 has sorted them; only an order by cleaned fields needs them first.

    Output: id, disc_id, summary, description, pos, split, tokens.
    """
    order = order_cols or ["id"]
    if {"summary", "description"} & set(order):
        placed = with_positions(materialize(preprocess_reports(raw)), order, "pos")
    else:
        placed = with_positions(raw, order, "pos", preprocess_reports)
    split = positional_split(placed, test_size)
    return split.withColumn("tokens", report_tokens())


def place_reports(df: DataFrame, test_size: float = 0.1, order_cols: list[str] | None = None) -> DataFrame:
    """ORD-1 + ORD-2 for reports that are already prepared (dense vectors)."""
    total = df.count()
    placed = with_positions(df, order_cols or ["id"], "pos")
    return positional_split(placed, test_size, total=total)


def dedup_documents(docs: DataFrame, tokens_col: str = "tokens", order_col: str = "file_id") -> DataFrame:
    """ROW-8: keep the earliest file of every distinct token structure.

    Grouping is by a digest of the nested tokens (partial aggregate on the
    digest; ``min_by`` keeps the earliest file), no pairwise comparison.
    """
    digest = F.sha2(F.to_json(F.col(tokens_col)), 256)
    keep = docs.groupBy(digest.alias("_dg")).agg(F.min(order_col).alias(order_col))
    return docs.join(keep.select(order_col), order_col, "left_semi")


def cap_examples(df: DataFrame, n_examples, order_col: str = "seq") -> DataFrame:
    """ROW-9: ``"all"`` or the first n rows by ``order_col`` (top-k sort)."""
    if n_examples == "all" or n_examples is None:
        return df
    return df.orderBy(order_col).limit(int(n_examples))


def shuffle_key(*cols, seed: int = 42):
    """ROW-10: deterministic shuffle order."""
    return h(*[F.col(c) for c in cols], seed=seed)


def training_corpus(reports_tokens: DataFrame, doc_sentences: DataFrame | None) -> DataFrame:
    """SET-1: corpus rows per train type. TASK/PT_TASK = report token lists;
    DOC_TASK/PT_DOC_TASK = reports plus all documentation sentences.

    Inputs: reports_tokens(tokens), doc_sentences(tokens). Output:
    (train_type, source, tokens).
    """
    rep, own = reports_tokens.select(F.lit("report").alias("source"), "tokens"), ["TASK", "PT_TASK"]
    if doc_sentences is None:
        return _of_types(rep, own)
    both = ["DOC_TASK", "PT_DOC_TASK"]
    docs = doc_sentences.select(F.lit("doc").alias("source"), "tokens")
    return _of_types(rep, own + both).unionByName(_of_types(docs, both))


def _of_types(rows: DataFrame, types: list[str]) -> DataFrame:
    """A copy of each row for each type; the rows are read and made once."""
    return rows.withColumn("train_type", F.explode(F.array(*map(F.lit, types))))

"""Corpus statistics (AGG-1..7) over token-list tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from dupescope.operators.groups import GROUP_ROWS, Group, grouped


def word_freq(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """AGG-1/AGG-2: (word, freq) over token occurrences (partial aggregation)."""
    return df.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def vocabulary(freq: DataFrame, min_count: int = 1) -> DataFrame:
    """AGG-3: words with frequency >= min_count."""
    return freq.filter(F.col("freq") >= min_count)


#: Documents that a group hands on at a time.
HANDED = 1024


class _Kept(Group):
    """A group's lists without the words that the table lacks."""

    def __init__(self, schema: pa.Schema):
        super().__init__()
        self.schema = schema

    def ready(self) -> None:
        if self._ready:
            return
        self._ready = True
        self.keys = pa.concat_arrays(self._keys)
        lists = pa.concat_arrays(self._tokens)
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        tokens = lists.flatten().dictionary_encode()
        self.words, self.codes = tokens.dictionary, pc.fill_null(tokens.indices, len(tokens.dictionary)).to_numpy()
        self.known = np.zeros(len(self.words) + 1, dtype=bool)  # the last is no word
        self._keys = self._tokens = None

    def met(self, part: pa.RecordBatch) -> None:
        self.known[self.coded(part.column("word"))] = True

    def result(self) -> Iterator[pa.RecordBatch]:
        begin = np.concatenate([[0], np.cumsum(self.size)])
        for lo in range(0, len(self.keys), HANDED):
            hi = min(lo + HANDED, len(self.keys))
            codes = self.codes[begin[lo]:begin[hi]]
            kept = self.known[codes]
            ends = np.concatenate([[0], np.cumsum(kept)])[begin[lo:hi + 1] - begin[lo]]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.words.take(pa.array(codes[kept])))
            yield pa.RecordBatch.from_arrays([self.keys.slice(lo, hi - lo), lists.cast(self.schema.field(1).type)], schema=self.schema)


def drop_rare_words(df: DataFrame, vocab: DataFrame, key: str = "pos", tokens_col: str = "tokens",
                    min_count: int = 1) -> DataFrame:
    """AGG-4: remove words outside ``vocab`` from each list, order and repeats
    kept; empty lists stay. ``min_count <= 1`` is a no-op. Rows are dealt to
    groups whole, and a group's distinct words meet ``vocab``, not every
    occurrence; no list is taken apart and no row is joined back."""
    if min_count <= 1:
        return df
    rows = df.select(F.struct(*(c for c in df.columns if c != tokens_col)).alias("_row"), tokens_col)
    out = StructType([rows.schema["_row"], StructField(tokens_col, ArrayType(StringType()))])
    schema = to_arrow_schema(out)
    kept = grouped(rows, vocab.select("word"), lambda: _Kept(schema), out, "_row", tokens_col)
    return kept.select(*(tokens_col if c == tokens_col else F.col("_row")[c].alias(c) for c in df.columns))


def corpus_properties(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """AGG-5: (distinct words, longest document)."""
    occ = df.select(F.size(tokens_col).alias("_n"), F.explode_outer(tokens_col).alias("w"))
    return occ.agg(F.count_distinct("w").alias("n_words"), F.max("_n").cast("bigint").alias("max_len"))


def cluster_summary(df: DataFrame) -> DataFrame:
    """AGG-6 (re-aimed): per duplicate cluster its size, first and last
    position, and the number of positive pairs / ordered triplets it yields.
    Aggregates only -- no member list is collected into one row."""
    return df.groupBy("disc_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    ).select(
        "disc_id", "size", "first_pos", "last_pos",
        (F.col("size") * (F.col("size") - 1) / 2).cast("bigint").alias("n_pos_pairs"),
        F.when(F.col("size") > 1, F.col("size") * (F.col("size") - 1)).otherwise(0).cast("bigint").alias("n_triplets"),
    )


def idf_table(train: DataFrame, tokens_col: str = "tokens", key: str = "pos") -> DataFrame:
    """AGG-7: document frequency and smoothed idf ``ln((1+n)/(1+df)) + 1``,
    fit on the training reports only."""
    n = train.count()  # one scalar
    dfreq = train.select(key, F.explode(F.array_distinct(tokens_col)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    return dfreq.select("term", "df", (F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


class _Features(Group):
    """A group's tf x idf, its terms in code-point order."""

    def __init__(self, schema: pa.Schema):
        super().__init__()
        self.schema, self.idf = schema, None

    def met(self, part: pa.RecordBatch) -> None:
        if self.idf is None:
            self.idf = np.full(len(self.words) + 1, np.nan)  # the last is no word
        self.idf[self.coded(part.column("word"))] = part.column("idf").to_numpy(zero_copy_only=False)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.idf is None:
            return
        order = pc.array_sort_indices(self.words).to_numpy()
        rank, n = np.empty(len(order) + 1, dtype=np.int64), len(order) + 1
        rank[order], rank[-1] = np.arange(n - 1), n - 1
        codes = np.repeat(np.arange(n), self.count)
        known = ~np.isnan(self.idf[codes])
        pairs, tf = np.unique(self.place[known].astype(np.int64) * n + rank[codes[known]], return_counts=True)
        place, term = np.divmod(pairs, n)
        weight = tf * self.idf[order[term]]
        norm = np.sqrt(np.bincount(place, weights=weight * weight, minlength=len(self.keys)))
        weight = weight / norm[place]
        words = self.words.take(pa.array(order))
        found, begin = np.unique(place, return_index=True)
        begin = np.append(begin, len(place))
        for lo in range(0, len(found), HANDED):
            own = found[lo:lo + HANDED]
            a, b = begin[lo], begin[lo + len(own)]
            offsets = pa.array((begin[lo:lo + len(own) + 1] - a).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, words.take(pa.array(term[a:b])))
            weights = pa.ListArray.from_arrays(offsets, pa.array(weight[a:b]))
            columns = [self.keys.take(pa.array(own)), terms.cast(self.schema.field(1).type), weights.cast(self.schema.field(2).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def tfidf_features(reports: DataFrame, idf: DataFrame, tokens_col: str = "tokens", key: str = "pos",
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """JOIN-5 features: raw tf x idf, L2-normalised; terms unseen in training
    are dropped. Returns (key, tf_terms, tf_weights) sorted by term; reports
    with no known term get empty arrays. Reports are dealt to groups with their
    tokens, and a group's distinct terms meet ``idf``, not every occurrence."""
    out = StructType([reports.schema[key], StructField("tf_terms", ArrayType(StringType())), StructField("tf_weights", ArrayType(DoubleType()))])
    schema = to_arrow_schema(out)
    feats = grouped(reports, idf.select(F.col("term").alias("word"), "idf"), lambda: _Features(schema), out, key, tokens_col, group_rows)
    return reports.select(key).join(feats, key, "left").select(
        key,
        F.coalesce("tf_terms", F.array().cast("array<string>")).alias("tf_terms"),
        F.coalesce("tf_weights", F.array().cast("array<double>")).alias("tf_weights"),
    )

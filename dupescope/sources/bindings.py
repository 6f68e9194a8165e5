"""Bindings of the driver's parquet tables to the report / docs data model.

* ``documents`` -> raw reports: first line = summary, rest = description,
  ``disc_id`` = lowest ``doc_id`` whose whole text has the same ``[a-z]``
  letters in lower case; a text without such letters is a cluster of its own.
* ``embeddings`` -> dense reports: ``disc_id`` = lowest ``vec_id`` of the label.
* ``conversations`` -> documentation sections: ``conv_id`` = section,
  ``turn`` = sentence index.
* ``pages`` -> documentation files (HTML).

A cluster key is read once from each text, into a table of (id, digest).
Cluster ids come from a partial ``min`` aggregate over (digest, id) and are
joined to the digest-id pairs, where a hot cluster is a skewed join that AQE
splits; texts are joined once, by id.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.session import materialize

#: All bytes but the letters a-z.
OTHER_BYTES = bytes(b for b in range(256) if not 97 <= b <= 122)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cluster_key(text_col) -> F.Column:
    """Digest of all letters of the text; null when it has none."""

    @F.pandas_udf("string")
    def digest(lowered: pd.Series) -> pd.Series:
        letters = [t.encode().translate(None, OTHER_BYTES) for t in lowered]
        return pd.Series([hashlib.md5(x, usedforsecurity=False).hexdigest() if x else None for x in letters], dtype=object)

    return digest(F.lower(F.coalesce(text_col, F.lit(""))))


def assign_clusters(df: DataFrame, key_col: str, id_col: str = "id", out_col: str = "disc_id") -> DataFrame:
    """``disc_id`` = lowest id sharing ``key_col`` (partial aggregate + join); a null key is shared by none."""
    first = df.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.min(id_col).alias("_first"))
    return df.join(first, key_col, "left").withColumn(out_col, F.coalesce("_first", id_col)).drop("_first")


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, summary, description, disc_id) from ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keys = assign_clusters(materialize(docs.select(F.col("doc_id").alias("id"), cluster_key(F.col("text")).alias("_ckey"))), "_ckey")
    nl = F.instr(F.col("text"), "\n")
    reports = docs.select(
        F.col("doc_id").alias("id"),
        F.when(nl > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text")).alias("summary"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("description"),
    )
    # the join deals the texts by id in any case; naming the number keeps AQE from merging the parts by their few bytes,
    # as cleaning them is heavy work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return reports.repartition(parts, "id").join(keys.select("id", "disc_id"), "id")


def dense_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, disc_id, vector) from ``embeddings``."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
    return assign_clusters(emb, "label").drop("label")


def doc_sentences_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, sent_idx, text) from ``conversations``."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("section_id"), F.col("turn").alias("sent_idx"), "text")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, ext, content) from ``pages``; every page is an HTML file."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("file_id"),
        F.col("url").alias("path"),
        F.lit("html").alias("ext"),
        F.col("html").alias("content"),
    )

"""Shared, named stages of the registered queries (reports, queries, vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.operators.rows import place_reports, prepare_reports
from dupescope.sources import bindings as B

TEST_SIZE = 0.1
KS = [1, 5, 10, 15, 20, 25]


def dense_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (id, disc_id, vector, pos, split)."""
    return place_reports(B.dense_reports(spark, sf_dir), TEST_SIZE)


def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (id, disc_id, summary, description, pos, split, tokens)."""
    return prepare_reports(B.raw_reports(spark, sf_dir), TEST_SIZE)

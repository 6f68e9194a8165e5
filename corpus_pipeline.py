"""From raw documents to packed training sequences: language, quality, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``, whatever they are called. The near-duplicate stage numbers the
rows in a written table, so that rows of repeated ids, or without an id, are told apart: exactly one row of each group stays.
An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.llm import langid, packing, quality_model, simhash
from dupescope.llm.common import merged_partitions, table, written
from dupescope.llm.tokens import default_vocabulary

#: A document whose calibrated quality is lower goes.
LEAST_QUALITY = 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language shows by a wide enough margin. A null text, or one without letters, shows none and goes; ties have no
    margin and go; repeated rows are each judged alike. Where no document has a language, nothing is learned and all stay."""
    dictionaries = langid.fit(docs)
    if not dictionaries:
        return docs
    return docs.where(~langid.predict(F.col("text"), dictionaries, docs)["rejected"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good: those whose score is LEAST_QUALITY or more, a tie included. Null and empty texts
    get a score as any other; a document without a label teaches nothing and is scored."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_model.score(F.col("text"), model, docs) >= LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest id, one without an id only if the group has no other, of equal ids the first
    row as read. Texts without words are copies of each other, null ones too."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:  # columns of any name pass through
        row = "_" + row
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-numbered")
    ids = numbered.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("_id"), "text")
    groups = simhash.near_duplicates(ids, "_id")
    first = groups.where(F.col("_id.row") == F.col("component_id.row")).select(F.col("_id.row").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens; a null text is its end id alone."""
    return packing.pack(docs.coalesce(merged_partitions(docs)), default_vocabulary())


STAGES = [("language", language_stage), ("quality", quality_stage), ("near duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Compression, kernel features and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

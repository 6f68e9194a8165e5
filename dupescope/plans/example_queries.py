"""Registered documentation example builders over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.functions import text as T
from dupescope.operators import examples as X
from dupescope.session import materialize
from dupescope.sources import bindings as B

FORGET_CONST = 10
MASK_PROBABILITY = 0.15


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections (conversations) -> prepared sentences with global ``seq``."""
    raw = B.doc_sentences_raw(spark, sf_dir)
    prepped = T.with_preprocessed(raw, {"_sec": F.col("text")})
    toks = prepped.select("section_id", "sent_idx",
                          F.flatten(F.coalesce("_sec", F.array().cast("array<array<string>>"))).alias("tokens"))
    return materialize(X.doc_sentences(toks.filter(F.size("tokens") > 0)))


def nsp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-5."""
    s = doc_sentences(spark, sf_dir)
    return X.next_sentence_pairs(s, s.count(), FORGET_CONST)


def sase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-6."""
    return X.same_section_pairs(doc_sentences(spark, sf_dir))


def sts_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-7."""
    s = doc_sentences(spark, sf_dir)
    return X.similarity_pairs(s, s.count(), FORGET_CONST)


def mlm_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-8."""
    return X.masked_tokens(doc_sentences(spark, sf_dir), MASK_PROBABILITY)


def tsdae_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-9."""
    return X.denoising_pairs(doc_sentences(spark, sf_dir))


def doc_sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROW-6: (seq, section_id, idx_in_section, sentence)."""
    return doc_sentences(spark, sf_dir).select("seq", "section_id", "idx_in_section", "sentence")


REGISTRY = {
    "doc_sentence_table": doc_sentence_table,
    "nsp_pairs": nsp_pairs,
    "sase_pairs": sase_pairs,
    "sts_pairs": sts_pairs,
    "mlm_masks": mlm_masks,
    "tsdae_pairs": tsdae_pairs,
}

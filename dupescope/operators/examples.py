"""Training-example tables built from documentation sentences (EX-5..10).

Random choices use the stateless hash ``h`` (same draw on any retry or
partitioning). Every builder is linear: one row per sentence, partners found
by equi joins on computed indices -- no pairs within a group are enumerated.

Input: ``sentences(seq, section_id, idx_in_section, sentence, tokens)`` with
``seq`` the global order (ROW-6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupescope.functions.hashing import h, uniform
from dupescope.operators.positions import rank_within, with_positions


def randint_except(low: Column, high: Column, excluded_sorted: Column, draw: Column) -> Column:
    """EX-10: uniform integer in [low, high) skipping a sorted exclusion list.

    ``draw`` is a non-negative integer; r0 = low + draw mod (high - low - |ex|),
    then every excluded value <= the running result shifts it up by one.
    Returns null when nothing is left to draw.
    """
    room = high - low - F.size(excluded_sorted)
    r0 = low + F.pmod(draw, F.greatest(room, F.lit(1)))
    shifted = F.aggregate(excluded_sorted, r0.cast("bigint"),
                          lambda acc, e: F.when(acc >= e, acc + 1).otherwise(acc))
    return F.when(room > 0, shifted)


def doc_sentences(sections: DataFrame) -> DataFrame:
    """ROW-6 + section-local index: (section_id, sent_idx, tokens) ->
    (seq, section_id, idx_in_section, sentence, tokens)."""
    placed = with_positions(sections, ["section_id", "sent_idx"], "seq")
    local = rank_within(placed.select("seq", "section_id"), ["section_id"], ["seq"], "idx_in_section")
    return placed.join(local, ["seq", "section_id"]).select(
        "seq", "section_id", "idx_in_section", F.array_join("tokens", " ").alias("sentence"), "tokens")


def _by_seq(s: DataFrame, name: str) -> DataFrame:
    return s.select(F.col("seq").alias(f"{name}_seq"), F.col("sentence").alias(f"sentence_{name}"))


def next_sentence_pairs(s: DataFrame, total: int, forget_const: int = 10, seed: int = 42) -> DataFrame:
    """EX-5: for every sentence but the last, with prob 1/2 the next sentence
    (label 0), else a uniform sentence outside [seq-f, seq+f] clipped to the
    corpus (label 1); no row when nothing is left to draw."""
    coin = uniform(F.lit("nsp"), F.col("seq"), seed=seed)
    lo = F.greatest(F.col("seq") - forget_const, F.lit(0))
    hi = F.least(F.col("seq") + forget_const, F.lit(total - 1))
    excluded = F.sequence(lo, hi)
    neg = randint_except(F.lit(0), F.lit(total), excluded, h(F.lit("nsp_neg"), F.col("seq"), seed=seed))
    base = s.filter(F.col("seq") < total - 1).select(
        "seq", F.col("sentence").alias("sentence_a"),
        F.when(coin >= 0.5, F.lit(0)).otherwise(F.lit(1)).alias("label"),
    )
    base = base.withColumn("b_seq", F.when(coin >= 0.5, F.col("seq") + 1).otherwise(neg))
    return base.filter(F.col("b_seq").isNotNull()).join(_by_seq(s, "b"), "b_seq").select(
        "seq", "b_seq", "label", "sentence_a", "sentence_b")


def same_section_pairs(s: DataFrame, seed: int = 42) -> DataFrame:
    """EX-6: for every sentence but a section's last, with prob 1/2 the next
    sentence of its section (label 0), else a uniform sentence of a uniform
    *other* section (label 1)."""
    sections = s.groupBy("section_id").agg(F.count(F.lit(1)).alias("sec_len"))
    n_sections = sections.count()
    ranked = with_positions(sections, ["section_id"], "sec_rank")
    me = s.join(ranked, "section_id").filter(F.col("idx_in_section") < F.col("sec_len") - 1)
    coin = uniform(F.lit("sase"), F.col("seq"), seed=seed)
    other = randint_except(F.lit(0), F.lit(n_sections), F.array(F.col("sec_rank")),
                           h(F.lit("sase_sec"), F.col("seq"), seed=seed))
    me = me.select(
        "seq", "section_id", "idx_in_section", F.col("sentence").alias("sentence_a"),
        F.when(coin >= 0.5, F.lit(0)).otherwise(F.lit(1)).alias("label"), "sec_rank", other.alias("other_rank"))
    pos = me.filter(F.col("label") == 0).join(
        s.select("section_id", (F.col("idx_in_section") - 1).alias("idx_in_section"),
                 F.col("seq").alias("b_seq"), F.col("sentence").alias("sentence_b")),
        ["section_id", "idx_in_section"])
    target = ranked.select(F.col("sec_rank").alias("other_rank"), F.col("section_id").alias("b_section"),
                           "sec_len")
    neg = (me.filter((F.col("label") == 1) & F.col("other_rank").isNotNull()).join(target, "other_rank")
           .withColumn("b_idx", F.pmod(h(F.lit("sase_idx"), F.col("seq"), seed=seed), F.col("sec_len")))
           .join(s.select(F.col("section_id").alias("b_section"), F.col("idx_in_section").alias("b_idx"),
                          F.col("seq").alias("b_seq"), F.col("sentence").alias("sentence_b")),
                 ["b_section", "b_idx"]))
    cols = ["seq", "b_seq", "label", "sentence_a", "sentence_b"]
    return pos.select(*cols).unionByName(neg.select(*cols))


def similarity_pairs(s: DataFrame, total: int, forget_const: int = 10, seed: int = 42) -> DataFrame:
    """EX-7: (i, i+1, 1.0) for i < L = total-1, and (i, j, 0.0) with j uniform
    in [i+f, L) when i + f < L."""
    last = total - 1
    pos = s.filter(F.col("seq") < last).select("seq", (F.col("seq") + 1).alias("b_seq"),
                                                F.lit(1.0).alias("label"), F.col("sentence").alias("sentence_a"))
    span = F.lit(last) - F.col("seq") - forget_const
    neg = s.filter(F.col("seq") + forget_const < last).select(
        "seq", (F.col("seq") + forget_const + F.pmod(h(F.lit("sts"), F.col("seq"), seed=seed), span)).alias("b_seq"),
        F.lit(0.0).alias("label"), F.col("sentence").alias("sentence_a"))
    return pos.unionByName(neg).join(_by_seq(s, "b"), "b_seq").select(
        "seq", "b_seq", "label", "sentence_a", "sentence_b")


def masked_tokens(s: DataFrame, mask_probability: float = 0.15, seed: int = 42, max_len: int | None = None) -> DataFrame:
    """EX-8: every token is replaced by ``[MASK]`` with probability p (drawn
    once per (sentence, position)); labels keep the full original."""
    toks = F.col("tokens") if max_len is None else F.slice("tokens", 1, max_len)
    masked = F.transform(toks, lambda t, k: F.when(
        uniform(F.lit("mlm"), F.col("seq"), k, seed=seed) < mask_probability, F.lit("[MASK]")).otherwise(t))
    return s.select("seq", F.array_join(masked, " ").alias("masked"), F.array_join(toks, " ").alias("labels"))


def denoising_pairs(s: DataFrame, del_ratio: float = 0.6, seed: int = 42) -> DataFrame:
    """EX-9: delete each word with probability ``del_ratio`` (keep when the
    draw exceeds it); if nothing is kept, keep one hashed word."""
    keep = F.filter("tokens", lambda t, k: uniform(F.lit("tsdae"), F.col("seq"), k, seed=seed) > del_ratio)
    one = F.array(F.element_at("tokens", (F.pmod(h(F.lit("tsdae_keep"), F.col("seq"), seed=seed),
                                                 F.size("tokens")) + 1).cast("int")))
    kept = F.try_element_at(F.filter(F.array(keep), lambda a: F.size(a) > 0), F.lit(1))  # null when empty
    noisy = F.when(F.size("tokens") == 0, F.col("tokens")).otherwise(F.coalesce(kept, one))
    return s.select("seq", F.array_join(noisy, " ").alias("noisy"), F.col("sentence").alias("target"))


# ---------------------------------------------------------------- UDF-3
#: Example builders by documentation task: ``(sentences, number of sentences) -> examples``.
BUILDERS = {
    "mlm": lambda s, total: masked_tokens(s),
    "sts": lambda s, total: similarity_pairs(s, total),
    "nsp": lambda s, total: next_sentence_pairs(s, total),
    "tsdae": lambda s, total: denoising_pairs(s),
    "sase": lambda s, total: same_section_pairs(s),
}


def build_examples(task: str, sentences: DataFrame) -> DataFrame:
    """UDF-3: the examples of a documentation task, by its name."""
    if task not in BUILDERS:
        raise ValueError(f"no builder for task {task}; known: {', '.join(sorted(BUILDERS))}")
    return BUILDERS[task](sentences, sentences.count())

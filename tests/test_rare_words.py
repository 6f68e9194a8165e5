"""Rare words are dropped in groups of rows."""

import random
from collections import Counter

from dupescope.operators import corpus as C


def test_rare_words_are_dropped_in_groups(spark):
    rnd = random.Random(2)
    rows = [(i, f"n{i}", [f"w{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(0, 9))]) for i in range(900)] + [(900, "null", None), (901, None, ["w1", None, "w1"])]
    df = spark.createDataFrame(rows, "pos bigint, name string, tokens array<string>")
    kept = C.drop_rare_words(df, C.vocabulary(C.word_freq(df), 2), min_count=2)
    n = Counter(w for r in rows for w in r[2] or [])
    assert kept.columns == df.columns and any(v == 1 for v in n.values())
    want = sorted((i, name or "", [w for w in tokens or [] if w is not None and n[w] >= 2]) for i, name, tokens in rows)
    assert sorted((r.pos, r.name or "", r.tokens) for r in kept.collect()) == want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan  # before: lists were taken apart and built again

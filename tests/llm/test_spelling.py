"""Spelling variants against all pairs by edit distance, and the query against the contract written plainly."""

import random
import re
import zlib
from collections import Counter

import pytest

from dupescope.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def expected(counts):
    near = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        for d in (-1, 0, 1):
            near[w] += [v for v in by_length.get(len(w) + d, ()) if one_edit(w, v)]
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(12)
    sounds = ["an", "er", "in", "é", "th", "ÿ", "o", "u", "st", "À"]
    words = {"".join(rng.choice(sounds) for _ in range(rng.randint(3, 6))) for _ in range(500)}
    words |= {w[:i] + rng.choice("aeoßé") + w[i + rng.randint(0, 1) :] for w in list(words) for i in [rng.randrange(len(w))]}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "abaaa", "x" * 32, "x" * 33, "x" * 34, "y" + "x" * 32, "x" * 64, "x" * 65, "x" * 2999 + "z", "x" * 3000, "x" * 3000 + "z"}
    words |= {f"hot{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}  # near in scores, under one key
    return {w: rng.choice([3, 3, 4, 6, 7, 12, 13, 50, 200]) for w in sorted(words) if len(w) >= 5}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_against_all_pairs(spark, counts):
    words = spark.createDataFrame([(n, "x", w) for w, n in counts.items()], "n bigint, form string, word string")
    assert rows_of(spelling.spelling_groups(words)) == expected(counts)
    assert spelling.spelling_groups(words.limit(0)).count() == 0
    plain = {tuple(r) for r in spelling.near_words(words).collect()}
    small = {tuple(r) for r in spelling.near_words(words, cell=40, block=64, chunk=32).collect()}
    assert plain == small


def test_chain_of_forms(spark):
    chain = {"".join("b" if j < i else "a" for j in range(9)): 3 << i for i in range(10)}
    words = spark.createDataFrame(list(chain.items()), "word string, n bigint")
    assert {r["root"] for r in spelling.spelling_groups(words).collect()} == {"b" * 9}


def query_expected(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return expected({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def test_query(spark, tmp_path, texts):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in enumerate([*texts, *["Ünder Under ÀÉÎ÷×ab under1under"] * 4, "w" * 90000, "w" * 90000, "w" * 90000, "w" * 90001])] + given[:60] + [(None, given[0][1]), given[1]]
    spark.createDataFrame([("x", *r) for r in docs], "word string, doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(queries.op12_spelling(spark, str(tmp_path))) == query_expected(docs)

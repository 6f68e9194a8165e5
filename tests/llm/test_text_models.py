"""Language identification, language-model scores, quality classifier and rules."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dupescope.llm import langid, quality_model, quality_rules, suffix_tree
from dupescope.llm.common import id_remainder

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_id_remainder(spark, remainder):
    got = spark.range(40).select("id", id_remainder("id", 7).alias("r")).collect()
    assert all(r.r == remainder(r.id, 7) for r in got)


def test_languages_apart(spark):
    aa, bb = "the and with from then other house water ".split(), "der und mit nicht auch schon haus wasser ".split()
    rows = [(i, " ".join((aa if i % 2 else bb)[(i * k) % 8] for k in range(1, 60)) + f"\n{i} !", "aa" if i % 2 else "bb") for i in range(80)]
    rows += [(100, None, "aa"), (101, "123 !!", "aa"), (102, "", None), (103, " ".join(aa), None), (104, " ".join(bb) * 900, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = langid.fit(docs)
    got = {r.doc_id: r.p for r in docs.select("doc_id", langid.predict(F.col("text"), learned, docs).alias("p")).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, lang in rows[:80])
    assert [got[i].lang_pred for i in range(100, 105)] == ["und", "und", "und", "aa", "bb"]
    assert all(got[i].rejected and got[i].score == 0 for i in (100, 101, 102))
    nothing = langid.fit(docs.where("doc_id < 0"))
    assert nothing == () and docs.limit(0).select(langid.predict(F.col("text"), learned, docs)).count() == 0
    assert docs.select(langid.predict(F.col("text"), nothing, docs)["lang_pred"].alias("l")).distinct().collect()[0].l == "und"
    alone = langid.fit(docs.where("lang = 'aa'"))
    assert not docs.where("doc_id = 103").select(langid.predict(F.col("text"), alone, docs)["rejected"].alias("r")).first().r


def test_bounded_sample_of_repeated_ids_and_many_languages(spark, monkeypatch):
    """One id on many rows, and many languages: the passages that reach the driver stay bounded."""
    rows = [(1, f"the house number {i} is on the river bank", "aa") for i in range(60)] + [(2 + i, "der fluss und das haus", f"l{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "dictionaries_of", lambda passages: seen.append(passages) or ())
    langid.fit(docs, passages=8, languages=4)
    assert list(seen[0]) == ["aa", "l0", "l1", "l2"] and len(seen[0]["aa"]) == 8


def test_sizes_are_of_whole_texts():
    """The winner is the smallest sum of block sizes, by compressing each block anew."""
    import zstandard

    learned = (("aa", b"the and with from then other house water " * 9), ("bb", b"der und mit nicht auch schon haus wasser " * 9))
    text = "the und with haus " * 400 + "der und mit nicht " * 500
    sums = []
    for _, content in learned:
        c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        low = langid.letters(text)
        sums.append(sum(len(c.compress(low[i : i + langid.BLOCK_CHARS].encode())) for i in range(0, len(low), langid.BLOCK_CHARS)))
    assert langid.Compressors(learned).predict(text, 0.01)[0] == learned[int(np.argmin(sums))][0]


def brute_tree(streams, p_min, tokens, words, below):
    """Retained contexts and chances by counting every sequence of the training texts."""
    counts = Counter(tuple(s[i : i + n]) for s in streams for n in range(1, suffix_tree.DEPTH + 2) for i in range(len(s) - n + 1))
    least = max(suffix_tree.LEAST, p_min * tokens)
    following = {}
    for seq, n in counts.items():
        if len(seq) > 1 and n >= least:
            following.setdefault(seq[:-1], {})[seq[-1]] = n
    root = lambda w: ((words.get(w, 0) if words.get(w, 0) >= p_min * tokens else 0) + 0.1) / below
    leave, chance, kept = {}, {}, set()

    def after(context, word):
        factor = 1.0
        while context in leave:
            if (context, word) in chance:
                return factor * chance[context, word]
            factor, context = factor * leave[context], context[1:]
        return factor * root(word)

    for context in sorted(following, key=len):
        if len(context) > 1 and context[1:] not in leave:
            continue
        n, entries = counts[context], following[context]
        left = (n - sum(entries.values()) + suffix_tree.PSEUDO) / (n + suffix_tree.PSEUDO)
        shorter = {w: after(context[1:], w) for w in entries}
        own = {w: c / (n + suffix_tree.PSEUDO) + left * shorter[w] for w, c in entries.items()}
        rest = max(1e-12, 1 - sum(own.values())), max(1e-12, 1 - sum(shorter.values()))
        gain = n * (sum(p * math.log(p / shorter[w]) for w, p in own.items()) + rest[0] * math.log(rest[0] / rest[1]))
        leave[context] = left
        chance.update({(context, w): p for w, p in own.items()})
        if gain >= suffix_tree.GAIN * (1 + len(entries)):
            kept.update(context[i:] for i in range(len(context)))
    return kept, chance, leave


def test_suffix_tree_and_baseline(docs, empty, texts, remainder):
    got = {r.doc_id: r for r in suffix_tree.language_model_scores(docs.repartition(3), id_remainder("doc_id", 10) != 0).collect()}
    streams = {i: ["\x02", *WORD.findall((t or "").translate(LOW)), "\x03"] for i, t in enumerate(texts)}
    training = [s for i, s in streams.items() if remainder(i, 10)]
    words = Counter(w for s in training for w in s[1:])
    tokens, different = sum(words.values()), len(words)
    below = tokens + 0.1 * (different + 1)
    kept, chance, leave = brute_tree(training, suffix_tree.P_MIN, tokens, words, below)
    assert any(len(c) == suffix_tree.DEPTH for c in kept)
    for i, s in streams.items():
        base = sum(math.log10((words[w] + 0.1) / below) for w in s[1:])
        score = 0.0
        for j in range(1, len(s)):
            context = next((tuple(s[j - d : j]) for d in range(suffix_tree.DEPTH, 0, -1) if d <= j and tuple(s[j - d : j]) in kept), ())
            while context and (context, s[j]) not in chance:
                score += math.log10(leave[context])
                context = context[1:]
            score += math.log10(chance[context, s[j]] if context else (words[s[j]] + 0.1) / below)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 10) == 0, len(s) - 1, sum(words[w] > 0 for w in s[1:]), tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9), i
    assert suffix_tree.language_model_scores(empty, F.lit(True)).count() == 0
    untrained = suffix_tree.language_model_scores(docs.limit(20), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in untrained)


def test_suffix_tree_keeps_rare_passages_of_a_large_corpus(spark):
    """A sequence's share of all tokens decides where it is looked up, never whether it is in the model."""
    passage = "once upon a time there was a small brown fox"
    rows = [(i, passage) for i in range(6)] + [(100 + i, " ".join(f"w{(i * 37 + k * k) % 91}" for k in range(90))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = lambda share: {r.doc_id: (r.n_known, r.base_score, r.score) for r in suffix_tree.language_model_scores(docs, F.lit(True), p_min=share).collect()}
    joined, carried = of(0.01), of(1e-9)
    assert joined[0][2] > joined[0][1] + 10
    assert all(np.allclose(joined[i], carried[i], rtol=1e-9) for i, _ in rows)
    keys, contexts = np.array([5, -7, 1 << 62]), np.array([-1, 3, -(1 << 61)])
    assert (suffix_tree.last_word(suffix_tree.joined(contexts, keys), contexts) == keys).all()


def test_word_hashes_and_lookup():
    import pyarrow as pa

    texts = [None, "", "  ", "a", "A b", " a\nb\x0b", "x" * 700_000 + " y", "\xa0é É\x85", "b " * 40_000 + "x" * 700_000]
    words = [WORD.findall((t or "").translate(LOW)) for t in texts]
    got = suffix_tree.tokens_of(pa.array(texts, pa.large_string()))
    assert got.many.tolist() == [len(w) for w in words]
    hashes, at = {}, 0
    for own in words:
        assert got.ids[at] == suffix_tree.BEGIN and got.ids[at + 1 + len(own)] == suffix_tree.END
        for w, h in zip(own, got.ids[at + 1 :].tolist(), strict=False):
            assert hashes.setdefault(w, h) == h
        at += len(own) + 2
    assert len(set(hashes.values())) == len(hashes)
    parts = [(lo, suffix_tree.tokens_of(x).many.tolist()) for lo, x in suffix_tree.pieces(pa.array(texts), 9)]
    assert [n for _, p in parts for n in p] == got.many.tolist() and [lo for lo, _ in parts][:2] == [0, 5]
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.integers(-(1 << 63), 1 << 62, 5000), np.arange(900), np.arange(-900, 0), [(1 << 63) - 1, -(1 << 63)]])
    keys = np.unique(keys)
    rng.shuffle(keys)
    asked = np.concatenate([keys, keys + 1, rng.integers(-(1 << 63), 1 << 62, 5000)])
    place, hit = suffix_tree.Lookup(keys).find(asked)
    assert (hit == np.isin(asked, keys)).all() and (keys[place[hit]] == asked[hit]).all()
    assert not suffix_tree.Lookup(keys[:0]).find(asked)[1].any()


def test_next_symbol_chances_sum_to_one(texts):
    streams = [["\x02", *WORD.findall((t or "").translate(LOW)), "\x03"] for t in texts]
    words = Counter(w for s in streams for w in s[1:])
    below = sum(words.values()) + 0.1 * (len(words) + 1)
    kept, chance, leave = brute_tree(streams, 1e-9, sum(words.values()), words, below)
    for context in list(kept)[:50]:
        total = 0.0
        for w in [*words, "never seen"]:
            factor, c = 1.0, context
            while c and (c, w) not in chance:
                factor, c = factor * leave[c], c[1:]
            total += factor * (chance[c, w] if c else (words.get(w, 0) + 0.1) / below)
        assert math.isclose(total, 1, rel_tol=1e-6)


def test_statistics_by_hand():
    got = quality_model.statistics_of([None, "", "Ab ab ab\nAb ab ab\n9 * !"])
    assert (got[:2] == 0).all()
    by = dict(zip(quality_model.STATISTICS, got[2], strict=True))
    assert math.isclose(by["words"], math.log1p(9)) and math.isclose(by["distinct"], 4 / 9) and math.isclose(by["top_word"], 6 / 9)
    assert math.isclose(by["same_as_last"], 5 / 9) and math.isclose(by["dup_lines"], 1 / 3) and math.isclose(by["upper"], 2 / 23)


def test_isotonic():
    weight, total = np.array([2.0, 0, 2, 2, 2]), np.array([0.0, 0, 2, 1, 2])
    assert np.allclose(quality_model.isotonic(weight, total), [0, 0.375, 0.75, 0.75, 1])
    assert (quality_model.isotonic(np.zeros(3), np.zeros(3)) == 0.5).all()


def test_quality_classifier(spark, docs, empty, texts):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(60)) if i % 3 else "BUY!! " * (20 + i), int(i % 3 > 0)) for i in range(150)]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = known.select("doc_id", "quality").unionByName(spark.createDataFrame([(3, None), (None, 1)], "doc_id bigint, quality int"))
    model = quality_model.fit(known.where("doc_id % 4 <> 2"), labels)
    got = known.where("doc_id % 4 = 2").select("quality", quality_model.score(F.col("text"), model, known).alias("s")).collect()
    assert all((r.s >= 0.7) == (r.quality == 1) and 0 <= r.s <= 1 for r in got)
    assert all(0 <= r.s <= 1 for r in docs.select(quality_model.score(F.col("text"), model, docs).alias("s")).collect())
    assert empty.select(quality_model.score(F.col("text"), model, empty)).count() == 0
    unlabelled = quality_model.fit(known, labels.limit(0))
    assert known.select(quality_model.score(F.col("text"), unlabelled, known).alias("s")).distinct().collect()[0].s == 0.5


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x " * int(rng.integers(1, 40)) + "Y" * int(rng.integers(0, 9)), int(rng.random() < 0.5)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(6)
    model = quality_model.fit(docs, docs.select("doc_id", "quality"))
    x = quality_model.statistics_of([t for _, t, _ in rows])
    z = quality_model.expanded(x, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))
    want = np.linalg.solve(z.T @ z + quality_model.RIDGE * np.diag([1.0] * quality_model.FEATURES + [0.0]), z.T @ np.array([y for _, _, y in rows], dtype=float))
    assert np.allclose(model.weights, want, atol=1e-6)


def base_by_hand(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, empty, texts):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(20, 70)] + [(None, 1, 0), (21, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(got) == len(texts)
    buckets = {}
    hashed = docs.select("doc_id", quality_rules.ngram_buckets(quality_rules.words(F.col("text")), quality_rules.BUCKETS).alias("g")).collect()
    trusted = {i for i in range(20, 70) if i % 5 > 0}
    every, good = Counter(), Counter()
    for r in hashed:
        buckets[r.doc_id] = r.g
        every.update(r.g)
        if r.doc_id in trusted:
            good.update(r.g)
    n_every, n_good, size = sum(every.values()), sum(good.values()), quality_rules.BUCKETS
    for i, t in enumerate(texts):
        r = got[i]
        want = base_by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert len(buckets[i]) == max(0, 2 * want[0] - 1)
        ratios = [math.log((good[g] + 1) / (n_good + size)) - math.log((every[g] + 1) / (n_every + size)) for g in buckets[i]]
        if ratios:
            assert math.isclose(r.score, sum(ratios) / len(ratios), rel_tol=1e-9, abs_tol=1e-12)
            assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
        else:
            assert r.score is None and not r.kept
    assert quality_rules.quality_rules(empty, labels).count() == 0

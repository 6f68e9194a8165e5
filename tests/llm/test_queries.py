"""The registered queries of operators that SQL can't express, on a whole small table, against the contract in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from dupescope.llm import queries
from dupescope.llm.tokens import default_vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t, {i: t.encode(r.text or "", add_special_tokens=False).ids for i, r in docs.items()}


def crc(xs):
    return zlib.crc32(np.array(xs, dtype="<u4").tobytes())


def test_op1(spark, docs, ids):
    rows = queries.op1_packing(spark, SF).collect()
    own, sequences = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, xs in ids[1].items():
        xs, at = [*xs, 2], 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(xs), crc(xs[at : at + r.length])) and r.length > 0
            at += r.length
        assert at == len(xs)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(len(x) + 1 for x in ids[1].values())
    assert own.keys() == docs.keys() and len(sequences) <= -(-total // 4096) + 3


def test_op2(spark, docs):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    assert got.keys() == docs.keys()
    learned = {r.lang for r in docs.values() if r.lang is not None}
    right = []
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        none = not re.search(r"[^\W\d_]", docs[i].text or "")
        assert (r.lang_pred == "und") == none and r.lang_pred in learned | {"und"}
        if r.held_out and docs[i].lang is not None and not none:
            right.append(r.lang_pred == docs[i].lang)
    assert len(right) > 30 and np.mean(right) >= 0.95


def test_op3(spark, docs):
    got = {r.doc_id: r for r in queries.op3_suffix_tree(spark, SF).collect()}
    tokens = {i: [*WORD.findall((r.text or "").translate(LOW)), None] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0
    assert got.keys() == docs.keys()
    assert sum(got[i].score for i in docs if held[i]) > sum(got[i].base_score for i in docs if held[i])


def test_op5(spark, docs, ids):
    for r in queries.op5_bpe(spark, SF).collect():
        own = ids[1][r.doc_id]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), sha(" ".join(map(str, own))), sha(ids[0].decode(own, skip_special_tokens=False)))


def test_op6(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = {}
    for q, x in rows.items():
        if q % 100 == 0:
            far = {i: math.sqrt(float(((y - x) ** 2).sum())) for i, y in rows.items() if i != q}
            want[q] = sorted(far.items(), key=lambda t: (t[1], t[0]))[:10]
    got = {}
    for r in queries.op6_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = sum(len({i for i, _ in own} & {got[q][k][0] for k in got[q]}) for q, own in want.items())
    assert got.keys() == want.keys() and hits >= 0.9 * 10 * len(want)
    for q, own in got.items():
        assert sorted(own) == list(range(1, 11))
        assert all(math.isclose(s, float(np.linalg.norm(rows[i] - rows[q])), rel_tol=1e-9) for i, s in own.values())


def test_op7(spark, docs):
    for r in queries.op7_quality_rules(spark, SF).collect():
        text = docs[r.doc_id].text or ""
        ws = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        covered = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws)) and not (r.base_failed and r.kept)


def test_op8(spark, docs, ids):
    at = 0
    got = {r.doc_id: r for r in queries.op8_token_files(spark, SF).collect()}
    for i in sorted(docs):
        own = [*ids[1][i], 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(own), crc(own))
        at += len(own)


def test_op9(spark, docs):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in queries.op9_quality_classifier(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and quality.get(r.doc_id) is not None:
            right.append(r.predicted == quality[r.doc_id])
    assert len(right) >= 10 and np.mean(right) >= 0.85


def test_op10(spark, docs):
    prints = {}
    for i, r in docs.items():
        ws = WORD.findall((r.text or "").translate(LOW))
        shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(docs)
    for k, a in enumerate(order):
        for b in order[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    for r in queries.op10_simhash(spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))

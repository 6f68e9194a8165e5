"""Packing, byte-pair encoding and token files against the tokenizers library."""

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dupescope.llm import bpe, packing, tokenfile, tokens
from dupescope.session import scratch_path

VOCABULARY = tokens.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def ids(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kind", [tokens.WordIds, bpe.TreeIds])
def test_ids_equal_the_library(kind, texts, ids, monkeypatch):
    encoder = kind(VOCABULARY)
    assert [x.tolist() for x in encoder.encode(texts)] == ids
    assert [x.tolist() for x in encoder.encode(texts)] == ids  # from the cache
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    monkeypatch.setattr(tokens, "ENCODE_CHARS", 500)
    assert [x.tolist() for x in encoder.encode(texts)] == ids


def test_merges_in_rows_and_one_at_a_time_agree(library):
    tree = bpe.TreeIds(VOCABULARY)
    for piece in ("a", "the", "thththererer", "abcabcabcabcabc", "z" * 37, "!!!!!!!!!!!"):
        symbols, _ = tree.table.symbols([piece])
        row = bpe.merge_rows(tree.table, symbols[None, :])[0]
        assert row[row >= 0].tolist() == bpe.merge_long(tree.table, symbols.tolist()) == library.encode(piece, add_special_tokens=False).ids


def test_encode_then_decode_in_spark(docs, empty, texts, ids, library):
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text", "score"), VOCABULARY), VOCABULARY)
    got = {r.doc_id: r for r in both.collect()}
    for i, x in enumerate(ids):
        assert np.frombuffer(got[i].ids, dtype="<u4").tolist() == x
        assert got[i].decoded == library.decode(x, skip_special_tokens=False)
        assert got[i].score == 0.5
    assert bpe.encode(empty, VOCABULARY).count() == 0
    assert bpe.Decoder(VOCABULARY).decode(np.array([320, 10**9], dtype=np.int64)) == library.decode([320])


def test_best_fit_decreasing():
    where, offset, n = packing.best_fit_decreasing(np.array([5, 4, 3, 2, 2, 1, 8]), 8)
    assert n == 4
    assert where.tolist() == [1, 2, 1, 2, 2, 3, 0]  # 5 + 3, 4 + 2 + 2, then 1 opens a window: all others are full
    assert offset.tolist() == [0, 0, 5, 4, 6, 0, 0]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500)
    where, offset, n = packing.best_fit_decreasing(lengths, 64)
    free, want = [], 0  # the same by looking at all open windows
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free[free.index(min(fits))] -= length
        else:
            free.append(64 - length)
            want += 1
    assert n == want


def test_packing_holds_every_id_once(docs, empty, ids):
    window = 64
    rows = packing.pack(docs, VOCABULARY, window=window, end_id=2, buffer_tokens=600).collect()
    whole = {i: np.array([*x, 2], dtype="<u4") for i, x in enumerate(ids)}
    seen = {i: 0 for i in whole}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length].tobytes()
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[i] == len(x) for i, x in whole.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_segments_round_trip():
    rng = np.random.default_rng(2)
    for n, most in ((0, 2), (1, 2**32), (5000, 2**32), (3000, 1), (2049, 2**17), (1024, 49408)):
        ids = rng.integers(0, most, n).astype("<u4")
        ids[::9] = 0
        data = tokenfile.encode_segment(ids, block=256)
        assert (tokenfile.decode_segment(data) == ids).all()
        assert (tokenfile.decode_segment(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    steady = np.full(4096, 40000, dtype="<u4")
    steady[::50] = 49407
    assert len(tokenfile.encode_segment(steady)) < 700  # width 0 and exceptions
    with pytest.raises(ValueError):
        tokenfile.decode_segment(b"XXXX" + bytes(20))


def test_token_files_in_order(spark, docs, empty, ids, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_TOKENS", 300)
    path = scratch_path(spark, f"test-token-files-{os.getpid()}")
    tokenfile.write_token_files(docs.repartition(5), path + "/a", VOCABULARY)
    start = 0
    rows = sorted(tokenfile.read_token_files(spark, path + "/a").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(len(ids)))
    for r, x in zip(rows, ids, strict=True):
        whole = np.array([*x, 1], dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (start, len(x) + 1, zlib.crc32(whole))
        start += len(x) + 1
    tokenfile.write_token_files(empty, path + "/b", VOCABULARY)
    assert tokenfile.read_token_files(spark, path + "/b").count() == 0

"""Operator 5: byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

A piece starts as its symbols. Leaf i of the tree holds ``rank * leaves + i`` of the pair that starts at symbol i (nothing, if
the pair has no rank), so the root is the leftmost pair of the lowest rank. A merge changes three leaves - the pair's own, its
right neighbour's (gone) and the one before - and their paths to the root. Merging ends when the root is empty.

Pieces of a run are first made distinct and then merged together, one merge in each piece per step, as arrays of trees of equal
size (``merge_rows``); very long pieces are merged one at a time (``merge_long``). Ids equal those of the tokenizers library for
the same vocabulary file; its normalizer and pre-tokenizer are used as they are, except that ASCII words, for which the split is
plain, go through the same pattern in Python.

Defined results: a null text counts as empty and has no ids; ids that the vocabulary lacks decode to nothing; other columns of
the input pass through untouched (a column named like the output column is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dupescope.llm.common import bounded_batches
from dupescope.llm.tokens import WordIds, gather, pooled

EMPTY = np.iinfo(np.int64).max
#: Pieces of more symbols are merged one at a time.
LONG_PIECE = 512
#: Pieces merged together at most.
ROWS = 8192


class MergeTable:
    """Pairs of symbols -> rank and merged symbol; the symbols of characters inside and at the end of a word."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("only plain byte-level BPE is supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        pairs = [(vocab[a] * self.size + vocab[b], vocab[a + b]) for a, b in model["merges"]]
        key = np.array([p[0] for p in pairs], dtype=np.int64)
        self.rank_of = {k: r for r, k in reversed(list(enumerate(key.tolist())))}
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([p[1] for p in pairs], dtype=np.int64)
        chars = max(ord(t[0]) for t in vocab if len(t.removesuffix(end)) == 1) + 1
        self.inner, self.last = np.full(chars, -1, dtype=np.int64), np.full(chars, -1, dtype=np.int64)
        for c in range(chars):
            self.inner[c], self.last[c] = vocab.get(chr(c), -1), vocab.get(chr(c) + end, -1)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Values of the leaves ``at`` for pairs of symbols (a symbol under 0: no pair)."""
        key = left * self.size + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (right >= 0) & (left >= 0), self.ranks[i] * size + at, EMPTY)

    def symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all pieces one after the other, and where each piece ends."""
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        out = self.inner[codes]
        out[ends - 1] = self.last[codes[ends - 1]]
        if (out < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return out, ends


def merge_rows(table: MergeTable, symbols: np.ndarray) -> np.ndarray:
    """Merge each row of symbols (-1 after its end) as far as it goes; left-over places hold -1."""
    rows, n = symbols.shape
    size = 1 << max(0, n - 1).bit_length()
    tree = np.full((rows, 2 * size), EMPTY, dtype=np.int64)
    if n > 1:
        at = np.arange(n - 1)
        tree[:, size : size + n - 1] = table.leaves(symbols[:, :-1], symbols[:, 1:], at, size)
    width = size // 2
    while width:
        tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        width //= 2
    out = symbols.copy()
    sym = np.concatenate([symbols, np.full((rows, 1), -1)], axis=1)  # place n stands for none
    after = np.tile(np.arange(1, n + 2), (rows, 1))
    after[:, n] = n
    before = np.tile(np.arange(-1, n), (rows, 1))
    live = np.flatnonzero(tree[:, 1] != EMPTY)
    while len(live):
        top = tree[live, 1]
        at, new = top % size, table.merged[top // size]
        gone = after[live, at]
        right, left = after[live, gone], before[live, at]
        sym[live, at], sym[live, gone] = new, -1
        after[live, at], before[live, right] = right, at
        back = np.maximum(left, 0)
        three = np.stack([at, gone, back])
        values = np.stack([table.leaves(new, sym[live, right], at, size), np.full(len(live), EMPTY), np.where(left >= 0, table.leaves(sym[live, back], new, back, size), EMPTY)])
        values[2] = np.where(left >= 0, values[2], values[0])  # no symbol before: the pair's own leaf again
        row = np.broadcast_to(live, three.shape)
        node = three + size
        tree[row, node] = values
        while node[0, 0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        live = live[tree[live, 1] != EMPTY]
    out[:] = sym[:, :n]
    return out


def merge_long(table: MergeTable, symbols: list[int]) -> list[int]:
    """The same for one piece of many symbols."""
    n, rank_of, merged, base = len(symbols), table.rank_of, table.merged, table.size
    size = 1 << max(0, n - 1).bit_length()
    sym = symbols + [-1]
    after, before = [*range(1, n + 1), n], [*range(-1, n)]

    def leaf(i: int) -> int:
        rank = rank_of.get(sym[i] * base + sym[after[i]]) if sym[after[i]] >= 0 else None
        return EMPTY if rank is None else rank * size + i

    tree = [EMPTY] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = leaf(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    while size > 1 and tree[1] != EMPTY:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        sym[at], sym[gone] = int(merged[rank]), -1
        after[at] = after[gone]
        before[after[at]] = at
        put(gone, EMPTY)
        put(at, leaf(at))
        if before[at] >= 0:
            put(before[at], leaf(before[at]))
    return [s for s in sym[:n] if s >= 0]


class TreeIds(WordIds):
    """Ids of texts by the segment tree; words are split and kept in the cache as in WordIds."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = MergeTable(spec)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parted = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def pieces(self, word: str) -> list[str]:
        """What the pre-tokenizer makes of a word, each in the characters that stand for its bytes."""
        if word.isascii() and word.isprintable():
            return self.split.findall(word.lower())
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = {i: self._marked(w) for i, w in enumerate(words) if self.parted and "<|" in w}
        lists = [self.pieces(w) if i not in marked else [] for i, w in enumerate(words)]
        every = list(dict.fromkeys(chain.from_iterable(lists)))
        place = {p: i for i, p in enumerate(every)}
        ends, pool = self.merge(every)
        flat, at = gather(ends, pool, np.fromiter((place[p] for ps in lists for p in ps), dtype=np.int64))
        many = np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        ends = np.concatenate([[0], at])[many]
        if not marked:
            return ends, flat
        return pooled([marked[i] if i in marked else flat[x:y].tolist() for i, (x, y) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))])

    def _marked(self, word: str) -> list[int]:
        """A word that may hold added tokens."""
        out: list[int] = []
        for part in self.parted.split(word):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.merge(self.pieces(part))[1].tolist()
        return out

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ends and pool of the ids of pieces."""
        if not pieces:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        symbols, ends = self.table.symbols(pieces)
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        kept = np.zeros(len(symbols), dtype=np.int64)
        kept[:] = -1
        classes = np.where(sizes <= LONG_PIECE, np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), -1)
        for c in np.unique(classes).tolist():
            rows = np.flatnonzero(classes == c)
            if c < 0:
                for r in rows.tolist():
                    done = merge_long(self.table, symbols[starts[r] : ends[r]].tolist())
                    kept[starts[r] : starts[r] + len(done)] = done
                continue
            step = max(1, min(ROWS, (1 << 18) >> c))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                n = int(sizes[some].max())
                place = starts[some][:, None] + np.arange(n)
                inside = np.arange(n) < sizes[some][:, None]
                done = merge_rows(self.table, np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], -1))
                kept[place[inside]] = done[inside]
        alive = kept >= 0
        return np.cumsum(alive)[ends - 1], kept[alive].astype("<u4")


class Decoder:
    """Ids -> text: tokens joined by one space, as the library does for a file without a decoder; added tokens are kept."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["decoder"] is not None:
            raise ValueError("only vocabularies without a decoder are supported")
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]

    def decode(self, ids: np.ndarray) -> str:
        n, tokens = len(self.tokens), self.tokens
        return " ".join([t for i in ids.tolist() if i < n and (t := tokens[i]) is not None])


@lru_cache(maxsize=2)
def encoder(path: str) -> TreeIds:
    return TreeIds(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


Batches = Iterator[pa.RecordBatch]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in names), values], names=[*names, name])


def encode_batches(vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        for batch in batches:
            ids = encoder(vocabulary).encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield with_column(batch, ids_col, pa.array([x.tobytes() for x in ids], pa.binary()))

    return task


def decode_batches(vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield with_column(batch, out_col, pa.array([decoder(vocabulary).decode(np.frombuffer(x or b"", dtype="<u4")) for x in ids], pa.string()))

    return task


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text: little-endian unsigned 32-bit integers in a binary column."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(encode_batches(vocabulary, text_col, ids_col), _added(df, ids_col, T.BinaryType()))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(decode_batches(vocabulary, ids_col, out_col), _added(df, out_col, T.StringType()))

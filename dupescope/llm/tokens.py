"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

The vocabulary's path is a parameter. Its normalizer and pre-tokenizer never join characters across ASCII white space,
and added tokens hold none, so the ids of a text are the ids of its white-space-separated words one after the other
(tests/llm checks this against the library on whole texts). The library then sees each distinct word of a run once.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dupescope.llm.common import runs

TAIL = r"^(?P<stem>(?s:.*)[A-Za-z0-9])(?P<tail>[!-&(-/:-@\[-`{-~]+)$"
#: Words kept in a worker's cache (about 50 MB), and the longest word that is kept.
CACHE_WORDS, CACHE_BYTES = 800_000, 64
#: Characters that are split into distinct words at a time, and words that the library encodes at a time.
ENCODE_CHARS, ASKED_WORDS = 8 << 20, 8192


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_wordwise(path: str) -> None:
    """Raise unless ids can be found word by word: white space must be dropped by the vocabulary's own rules."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec.get("added_tokens", []):
        if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) or "<|" not in t["content"]:
            raise ValueError(f"added token {t['content']!r} can't be matched inside a word")
    pre = spec["pre_tokenizer"]
    steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
    split = steps[0]
    if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or r"\s" not in split["pattern"]["Regex"]:
        raise ValueError("the vocabulary keeps white space; encode whole texts instead")
    if not any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"]):
        raise ValueError("the vocabulary keeps upper case; encode whole texts instead")
    if any(s["type"] == "ByteLevel" and s["add_prefix_space"] for s in steps):
        raise ValueError("the vocabulary adds a prefix space; encode whole texts instead")


class WordIds:
    """``texts -> ids`` as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_wordwise(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        """The cache: words, and for each where its ids end in ``pool``."""
        self.words = pa.array([], type=pa.large_string())
        self.ends = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        out: list[np.ndarray] = []
        for lo, hi in runs(texts, ENCODE_CHARS):
            words = pc.ascii_split_whitespace(pa.array([t or "" for t in texts[lo:hi]], type=pa.large_string()))
            coded = words.flatten().dictionary_encode()
            ends, pool = self._unique(coded.dictionary)
            flat, at = gather(ends, pool, coded.indices.to_numpy())
            at = np.concatenate([[0], at])[words.offsets.to_numpy() - words.offsets[0].as_py()]
            out += [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ends and pool of the ids of words that the cache doesn't have; a part of them at a time, as the library's results
        take a kilobyte a word."""
        parts = [pooled([e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + ASKED_WORDS], add_special_tokens=False)]) for i in range(0, len(words), ASKED_WORDS)]
        if not parts:
            return pooled([])
        ends, pools = zip(*parts, strict=True)
        before = np.cumsum([0, *(len(p) for p in pools[:-1])])
        return np.concatenate([e + b for e, b in zip(ends, before, strict=True)]), np.concatenate(pools)

    def _unique(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ends and pool of the ids of different words.

        A word that ends in ASCII letters or digits and then ASCII marks other than an apostrophe is looked up as these two
        parts, as the pre-tokenizer always splits between them. A part in ASCII alone is lower-cased, as the vocabulary does;
        beside other characters that could change how they compose. Words that may hold an added token stay as they are.
        """
        plain = pc.invert(pc.match_substring(words, "<|"))
        two = pc.extract_regex(words, TAIL)
        two = pc.if_else(pc.and_(plain, pc.is_valid(two)), two, pa.scalar(None, two.type))
        stem, tail = pc.coalesce(pc.struct_field(two, "stem"), words), pc.fill_null(pc.struct_field(two, "tail"), "")
        stem = pc.if_else(pc.and_(plain, pc.string_is_ascii(stem)), pc.ascii_lower(stem), stem)
        coded = pa.concat_arrays([stem, tail]).dictionary_encode()
        ends, pool = self._parts(coded.dictionary)
        flat, at = gather(ends, pool, coded.indices.to_numpy().reshape(2, -1).T.ravel())
        return at[1::2], flat

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        seen = pc.index_in(parts, self.words)
        missing = pc.is_null(seen)
        new = parts.filter(missing)
        new_ends, new_pool = self.encode_words(new.to_pylist())
        which = pc.fill_null(seen, 0).to_numpy().astype(np.int64)
        which[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        ends, pool = np.concatenate([self.ends, new_ends + len(self.pool)]), np.concatenate([self.pool, new_pool])
        flat, at = gather(ends, pool, which)
        if len(self.words) + len(new) > CACHE_WORDS:  # what this run holds stays, the rest is let go
            self.words, self.ends, self.pool = self._short(parts, at, flat)
        else:
            words, short_ends, short_pool = self._short(new, new_ends, new_pool)
            self.words = pa.concat_arrays([self.words, words])
            self.ends, self.pool = np.concatenate([self.ends, short_ends + len(self.pool)]), np.concatenate([self.pool, short_pool])
        return at, flat

    @staticmethod
    def _short(words: pa.Array, ends: np.ndarray, pool: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words that may be kept, CACHE_WORDS at most."""
        short = np.flatnonzero(pc.less_equal(pc.binary_length(words), CACHE_BYTES).to_numpy(zero_copy_only=False))[:CACHE_WORDS]
        flat, at = gather(ends, pool, short)
        return words.take(pa.array(short)), at, flat


def pooled(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
    return ends, np.fromiter(chain.from_iterable(lists), dtype="<u4", count=int(ends[-1]) if len(lists) else 0)


def gather(ends: np.ndarray, pool: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the lists ``which`` one after the other, and where each one ends. List i of ``pool`` ends at ``ends[i]``."""
    sizes = np.diff(ends, prepend=0)
    size = sizes[which]
    at = np.cumsum(size)
    if not len(at) or not at[-1]:
        return pool[:0], at
    kind = np.int32 if max(len(pool), at[-1]) < 1 << 31 else np.int64  # half the memory of the largest intermediates
    place = np.repeat((ends[which] - at).astype(kind), size)
    place += np.arange(at[-1], dtype=kind)
    return pool[place], at


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder for each vocabulary and worker process."""
    return WordIds(path)

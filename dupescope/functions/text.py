"""Text preparation as native Column expressions (TXT-1..14, TXT-20).

Column functions compile to JVM regex / higher-order functions; the DataFrame
form at the end does the same steps in Arrow's string kernels. Patterns spell
the "word character" class out as ``[\\p{L}\\p{N}_]`` (letters, numbers,
underscore): that is the Unicode word class of the original's regex engine, and
the same text works for the DuckDB oracle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from dupescope.functions.lexicon import STOP_WORDS, VERB_LEMMAS

WORD = r"[\p{L}\p{N}_]"

# FIXED VALUES: cleaning patterns in pipeline order (Java regex dialect).
# The digit and form-feed patterns take a word from its start, found by a
# look-behind: the original's leftmost match always starts there, so results are
# the same, while the search stays linear in the word length. A form feed right
# after a match has no word of its own before it (the match took it).
URL_PATTERN = r"(?:https|http)?://[\p{L}\p{N}_./?=&%]*[\p{L}\p{N}_]"
WORD_START = r"(?<![\p{L}\p{N}_])"
DIGIT_WORD_PATTERN = WORD_START + WORD + r"*?\p{Nd}" + WORD + "*"
FORM_FEED_WORD_PATTERN = "(?:" + WORD_START + WORD + r"++)?\f" + WORD + "*"
PAREN_PATTERN = r"(?d)\(.*?\)"
BRACKET_PAREN_PATTERN = r"(?d)\[.*\]\)"
NON_ASCII_PATTERN = r"[^\x00-\x7F]+"
SENTENCE_END_PATTERN = r"([.!?])[ \t\n\f\r\x0B]+"
SENTENCE_MARK = "\u0001"
TOKEN_PATTERN = r"[a-z_]+"
MIN_TOKEN_LEN = 3
MAX_TOKEN_LEN = 15
MIN_SENTENCE_CHARS = 4
MIN_SENTENCE_TOKENS = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_urls(c) -> Column:
    """TXT-1: URLs vanish (empty replacement); ``ftp://x`` leaves ``ftp``.
    The ``://`` guard reads the input twice, so it is only cheap (and only
    used) on the first step of the chain, whose input is a plain column."""
    c = _c(c)
    return F.when(F.instr(c, "://") > 0, F.regexp_replace(c, URL_PATTERN, "")).otherwise(c)


def remove_digit_words(c) -> Column:
    """TXT-2: any word holding a digit becomes one space."""
    return F.regexp_replace(_c(c), DIGIT_WORD_PATTERN, " ")


def remove_form_feed_words(c) -> Column:
    """TXT-3: words touching a form feed become one space."""
    return F.regexp_replace(_c(c), FORM_FEED_WORD_PATTERN, " ")


def remove_parens(c) -> Column:
    """TXT-4: shortest ``( ... )`` inside one line becomes a space."""
    return F.regexp_replace(_c(c), PAREN_PATTERN, " ")


def remove_bracket_paren(c) -> Column:
    """TXT-5: greedy ``[ ... ])`` inside one line becomes a space."""
    return F.regexp_replace(_c(c), BRACKET_PAREN_PATTERN, " ")


def remove_non_ascii(c) -> Column:
    return F.regexp_replace(_c(c), NON_ASCII_PATTERN, "")


def ascii_lower(c) -> Column:
    """TXT-6: drop non-ASCII characters, then lower-case."""
    return F.lower(remove_non_ascii(c))


def flatten_whitespace(c) -> Column:
    """TXT-7: newline and tab become spaces (a search for two bytes; ``translate`` looks up each character)."""
    return F.replace(F.replace(_c(c), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))


def _where(needed: Column, c, step) -> Column:
    """``step`` of ``c`` where a text needs it. The one-element array names
    ``c`` once; a text that needs no step is not decoded and searched for it."""
    return F.transform(F.array(c), lambda x: F.when(needed, step(x)).otherwise(x))[0]


def remove_noise(c) -> Column:
    """TXT-8: TXT-1..7 in the original order. A test of the raw text picks the
    steps: they only delete or leave spaces, so a text without digits, form
    feeds, brackets or other characters gets none on the way."""
    raw = _c(c)
    x = remove_urls(raw)
    x = _where(raw.rlike(r"\p{Nd}"), x, remove_digit_words)
    x = _where(F.instr(raw, "\f") > 0, x, remove_form_feed_words)
    x = _where(F.instr(raw, "(") > 0, x, remove_parens)
    x = _where(F.instr(raw, "[") > 0, x, remove_bracket_paren)
    x = _where(F.octet_length(raw) > F.length(raw), x, remove_non_ascii)
    return flatten_whitespace(F.lower(x))


def split_sentences(c) -> Column:
    """TXT-9: cut after ``.``, ``!`` or ``?`` followed by white space; keep
    sentences longer than 3 characters (rule-based stand-in for Punkt)."""
    marked = F.regexp_replace(_c(c), SENTENCE_END_PATTERN, "$1" + SENTENCE_MARK)
    parts = F.split(marked, SENTENCE_MARK)
    return F.filter(parts, lambda s: F.length(s) >= MIN_SENTENCE_CHARS)


def tokenize(c) -> Column:
    """TXT-10: digit-free word runs, 3..15 chars, not starting with ``_``."""
    toks = F.regexp_extract_all(_c(c), F.lit(TOKEN_PATTERN), 0)
    return F.filter(
        toks,
        lambda t: (F.length(t) >= MIN_TOKEN_LEN) & (F.length(t) <= MAX_TOKEN_LEN) & ~t.startswith("_"),
    )


def _word_array(words) -> Column:
    """A literal string array built from one string (one JVM call; Catalyst
    folds ``split`` of a literal into an array constant)."""
    return F.split(F.lit(" ".join(words)), " ")


def remove_stop_words(tokens) -> Column:
    """TXT-11: drop stop words, keeping order and repeats (not array_except).
    ``isin`` over a long literal list is planned as a hash ``InSet``."""
    return F.filter(_c(tokens), lambda t: ~t.isin(STOP_WORDS))


def lemmatize(tokens) -> Column:
    """TXT-12: verb base form from the fixed lemma table; unknown -> itself.
    A hash ``InSet`` test guards the (linear) map lookup, so the common
    unknown token costs one hash probe."""
    lemmas = F.map_from_arrays(_word_array(VERB_LEMMAS.keys()), _word_array(VERB_LEMMAS.values()))
    keys = list(VERB_LEMMAS)
    return F.transform(_c(tokens), lambda t: F.when(t.isin(keys), F.try_element_at(lemmas, t)).otherwise(t))


def normalize_sentence(sentence) -> Column:
    """TXT-10..12 for one sentence string -> token array."""
    return lemmatize(remove_stop_words(tokenize(sentence)))


def keep_long_sentences(sections) -> Column:
    """TXT-13: keep sentences with >= 3 tokens; nothing left -> null."""
    kept = F.filter(_c(sections), lambda s: F.size(s) >= MIN_SENTENCE_TOKENS)
    # one reference to ``kept``: wrap, drop the wrapper when empty, unwrap
    return F.try_element_at(F.filter(F.array(kept), lambda a: F.size(a) > 0), F.lit(1))


def preprocess(c) -> Column:
    """TXT-14: text -> array<array<string>> (sentences of tokens) or null."""
    sentences = split_sentences(remove_noise(c))
    return keep_long_sentences(F.transform(sentences, normalize_sentence))


def join_tokens(tokens) -> Column:
    """TXT-20: token list -> space-joined string."""
    return F.array_join(_c(tokens), " ")


def format_sections(sections) -> Column:
    """Readable text form of array<array<string>>: tokens by space, sentences by ' | '."""
    return F.array_join(F.transform(_c(sections), lambda s: F.array_join(s, " ")), " | ")


# ---------------------------------------------------------------- DataFrame form
# TXT-1..6 for Arrow's kernels, in pipeline order: pattern, replacement, and characters without which nothing matches.
# Their regex engine (RE2, as in the DuckDB oracle) searches in linear time without a look-behind, and takes the leftmost
# match, which starts where the word starts.
ARROW_STEPS = [
    (URL_PATTERN, "", "://"),
    (WORD + r"*\p{Nd}" + WORD + "*", " ", None),
    (WORD + r"*\f" + WORD + "*", " ", "\f"),
    (r"\(.*?\)", " ", "("),
    (r"\[.*\]\)", " ", "])"),
    (NON_ASCII_PATTERN, "", None),
]
#: Texts that are cleaned at a time.
CLEANED = 256


def _bytes_in(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), list(chars.encode()))


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_LETTER, _END, _WHITE = _bytes_in("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"), _bytes_in(".!?"), _bytes_in(" \t\n\f\r\x0B")


def _sections(texts: pa.Array) -> pa.Array:
    """TXT-14 of each text: its sentences of tokens, or null."""
    x = pc.fill_null(texts, "")
    for pattern, replacement, needed in ARROW_STEPS:
        if needed is None or pc.any(pc.match_substring(x, needed)).as_py():
            x = pc.replace_substring_regex(x, pattern, replacement)
    begin = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[begin[0]:begin[-1]]
    begin = begin - begin[0]
    # runs of letters, none over two texts
    letter = _LETTER[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    heads, tails = begin[:-1][begin[:-1] < len(data)], begin[1:][begin[1:] > 0] - 1
    first[heads], last[tails] = letter[heads], letter[tails]
    at, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= at
    fit = (size >= MIN_TOKEN_LEN) & (size <= MAX_TOKEN_LEN) & (data[at] != ord("_"))
    at, size = at[fit], size[fit]
    ends = _offsets(size)
    chars = _LOWER[data[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]]
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(chars))
    # a sentence of three tokens has more than 3 characters, so TXT-9's least length needs no test
    cut = data == ord(SENTENCE_MARK)
    cut[:-1] |= _END[data[:-1]] & _WHITE[data[1:]]
    text = np.searchsorted(begin, at, side="right") - 1
    sentence = np.cumsum(cut, dtype=np.int32)[at] + text
    used = ~pc.is_in(tokens, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
    tokens, text, sentence = tokens.filter(pa.array(used)), text[used], sentence[used]
    head = np.flatnonzero(np.diff(sentence, prepend=-1))
    size = np.diff(head, append=len(sentence))
    kept = size >= MIN_SENTENCE_TOKENS
    tokens = tokens.filter(pa.array(np.repeat(kept, size)))
    tokens = pc.coalesce(pa.array(VERB_LEMMAS.values()).take(pc.index_in(tokens, value_set=pa.array(VERB_LEMMAS.keys()))), tokens)
    n = np.bincount(text[head[kept]], minlength=len(x))
    lists = pa.ListArray.from_arrays(pa.array(_offsets(size[kept])), tokens)
    return pa.ListArray.from_arrays(pa.array(_offsets(n)), lists, mask=pa.array(n == 0))


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def with_preprocessed(df, mapping: dict[str, Column | str]):
    """TXT-14 for several columns: ``{out_col: input text column}``.

    The same rows as ``preprocess``, by Arrow's string kernels over batches of
    texts; tokens and sentences are cut in their bytes, which are ASCII by then.
    """

    @F.arrow_udf("array<array<string>>")
    def sections(texts: pa.Array) -> pa.Array:
        parts = [_sections(texts.slice(lo, CLEANED)) for lo in range(0, len(texts), CLEANED)]
        return pa.concat_arrays(parts or [_sections(texts)])

    return df.withColumns({out: sections(_c(c)) for out, c in mapping.items()})

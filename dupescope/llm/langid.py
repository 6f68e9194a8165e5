"""Operator 2: language identification by compression.

For each language a zstandard raw-content dictionary is built from passages of its labelled texts. A text, as lower-case letters
and spaces, is cut into blocks; each block is compressed with every dictionary on its own, and the sizes are summed over the
whole text. The smallest sum names the language. A document is rejected if the next language's sum is larger by less than
``margin`` (as a share of the smallest).

The dictionaries are fitted on a bounded sample: for each of at most ``LANGUAGES`` languages at most ``PASSAGES`` texts, picked by
a hash of the id, and one passage of at most ``PASSAGE_CHARS`` characters at a hashed place of each (of the different texts of a
repeated id the first passages, so that the bound holds for them, too). Texts of one language quote lines of another; so
the passages are halved, and a line that the dictionaries of the other half give to another language is left out. Nothing else
is learned but the languages' order by number of texts, which settles ties. Prediction reads nothing but the text.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; rows without a language teach
nothing; without any labelled text every prediction is ``und``; with one language there is no margin to reject by; ties go to
the language of more labelled texts, then the first by code point; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupescope.llm.common import bounded_batches

PASSAGES, PASSAGE_CHARS = 256, 2000
#: Languages at most: those of the most labelled texts.
LANGUAGES = 512
#: zstandard level, and the characters in a block.
LEVEL, BLOCK_CHARS = 5, 2048
MARGIN = 0.01
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes of sum that make one language e times likelier in the score.
SCORE_BYTES = 4.0


Dictionaries = tuple[tuple[str, bytes], ...]


def letters(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower()).strip()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", passages: int = PASSAGES, languages: int = LANGUAGES) -> Dictionaries:
    """Languages, those of more texts first, and their dictionaries. Ids and hashes are ranked first; texts are read for the
    picked ids alone, and at most ``passages`` of a language come to the driver."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    keys = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("hash"))
    many = {r.lang: r.n for r in keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()}
    picked = keys.withColumn("rank", rank).where(F.col("rank") <= passages).select("id").distinct()
    place = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), F.greatest(F.length(text_col) - PASSAGE_CHARS, F.lit(0)) + 1)
    passage = F.col(text_col).substr(place.cast("int"), F.lit(PASSAGE_CHARS))
    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), passage.alias("passage")).join(F.broadcast(picked), "id", "left_semi")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("id", "passage"))
    found: dict[str, list[str]] = {}
    for r in texts.distinct().withColumn("n", first).where(F.col("n") <= passages).orderBy("lang", "id", "passage").collect():
        if r.lang in many:
            found.setdefault(r.lang, []).append(r.passage)
    return dictionaries_of({lang: found[lang] for lang in sorted(found, key=lambda x: (-many[x], x))})


def dictionaries_of(passages: dict[str, list[str]]) -> Dictionaries:
    halves = [[(lang, [x for p in ps[h::2] for t in p.split("\n") if (x := letters(t))]) for lang, ps in passages.items()] for h in (0, 1)]
    judges = [Compressors(tuple((lang, "\n".join(xs).encode()) for lang, xs in half)) for half in halves]
    out = []
    for one, two in zip(*halves, strict=True):
        every = one[1] + two[1]
        own = [x for xs, judge in ((one[1], judges[1]), (two[1], judges[0])) for x in xs if judge.predict(x, 0.0)[0] == one[0]]
        out.append((one[0], "\n".join(dict.fromkeys(own if 2 * len(own) > len(every) else every)).encode()))
    return tuple(out)


class Compressors:
    def __init__(self, dictionaries: Dictionaries):
        import zstandard as Z

        self.langs = [lang for lang, _ in dictionaries]
        self.each = []
        for _, content in dictionaries:
            words = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if words:
                words.precompute_compress(level=LEVEL)
            self.each.append(Z.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None, margin: float) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether it is rejected."""
        low = letters(text or "")
        if not low or not self.langs:
            return UNKNOWN, 0.0, 0.0, True
        blocks = [low[i : i + BLOCK_CHARS].encode("utf-8", "surrogatepass") for i in range(0, len(low), BLOCK_CHARS)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.each]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        gap = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        score = 1 / sum(math.exp((best - s) / SCORE_BYTES) for s in sizes)
        return self.langs[order[0]], score, gap, gap < margin


@lru_cache(maxsize=4)
def compressors(dictionaries: Dictionaries) -> Compressors:
    return Compressors(dictionaries)


def predict(text: Column, dictionaries: Dictionaries, docs: DataFrame, margin: float = MARGIN) -> Column:
    """A struct column: ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = compressors(shared.value)
        for texts in batches:
            yield pd.DataFrame([model.predict(t, margin) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return languages(text)

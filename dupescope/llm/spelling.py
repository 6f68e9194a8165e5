"""Operator 12: words that differ by one letter, grouped under the most frequent spelling, by a bit-sliced position index.

Near words differ by one inserted, deleted or replaced code point. A block of the vocabulary is an index of bitsets: for each
position and letter the words that have it there. A word is sought in a whole block at once, letter by letter, over four
sets of its words: those without error so far, with one replaced letter, with one letter too many (read at the next position) and
with one too few (read at the position before). Sixty-four words move in each machine word. Words in a block stand by falling
count, so how many words are near is a count of bits and the most frequent one is the first bit; no pair is ever listed.

Blocks hold what can be near: two near words agree in their first or in their last k letters, k being half of the shorter
one's length at most (2 to 4 here). So each word is filed twice, by its first and by its last letters, and sought in both files
for the lengths next to its own; a pair that agrees in front counts there alone. Keys are hashed to cells of about CELL words. A cell of
more words is split into blocks and one of many queries into chunks, each pair of which is a task's work, so no key is
too large. Words of over 32 letters have files of their own, with narrower blocks by length, which bounds an index's bytes.

Forms: a word's form is its near word of largest count, if that is twice its own or more. Counts at least double along the
way from form to form, so the way to the root is short and is walked by joins that double their stride.

Defined results: a null text has no words; words of ties in count come by code point; repeated rows count as often as they
stand there; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupescope.llm.common import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences of a word at least, and how many times a word's count its form has.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Words of a cell on average, of a block at most (of class 2 or less), queries of a chunk, 64-bit words of a set of queries.
CELL, BLOCK, CHUNK, BATCH = 1 << 12, 1 << 15, 1 << 16, 1 << 16


def runs_of(docs: DataFrame, text_col: str = "text", *others: str) -> DataFrame:
    """``run``: the words of texts with A-Z in lower case, a row for each occurrence, beside other columns."""
    low = F.translate(text_col, UPPER, LOWER)
    return docs.select(*others, F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words (a column ``word``, a row for each occurrence) that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def class_of(length: Column) -> Column:
    """0: up to 6 code points, 1: up to 8, 2: up to 32, 3: up to 64, 4: up to 128 and so on."""
    more = F.length(F.bin(F.shiftright(length - 1, 5)))  # bits of (length - 1) div 32, one for 0
    return F.when(length <= 6, 0).when(length <= 8, 1).when(length <= 32, 2).otherwise(2 + more)


def filed(word: Column, kind: Column, buckets: int) -> Column:
    """Both cells of a class in which a word is filed or sought, as structs of ``side``, ``kind`` and ``bucket``."""
    k = F.least(kind + 2, F.lit(4))
    place = lambda side, key: F.struct(F.lit(side).alias("side"), kind.cast("int").alias("kind"), F.pmod(F.xxhash64(F.lit(side), kind, key), F.lit(buckets)).alias("bucket"))
    return F.array(place(0, word.substr(F.lit(1), k)), place(1, F.right(word, k)))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), np.fromiter(map(len, words), dtype=np.int64, count=len(words))


class Index:
    """Bitsets over words: ``table[rows[position, letter]]`` holds the words with that letter there, its last row none."""

    def __init__(self, words: list[str]):
        points, lengths = letters(words)
        self.alphabet, letter = np.unique(points, return_inverse=True)
        word = np.repeat(np.arange(len(words)), lengths)
        position = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.width, top, wide = -(-len(words) // 64), int(lengths.max()), len(self.alphabet) + 1
        used, row = np.unique(position * wide + letter, return_inverse=True)
        self.table = np.zeros((len(used) + 1, self.width), dtype=np.uint64)
        self.none = len(used)
        self.rows = np.full((top + 2) * wide, self.none, dtype=np.int64)  # positions from 0 to the longest word's length + 1
        self.rows[used] = np.arange(len(used))
        self.rows = self.rows.reshape(top + 2, wide)
        bit = np.left_shift(np.uint64(1), (word & 63).astype(np.uint64))
        np.bitwise_or.at(self.table.reshape(-1), row * self.width + (word >> 6), bit)
        self.of_length = {int(n): self.bits(np.flatnonzero(lengths == n)) for n in np.unique(lengths)}
        self.no_word = np.zeros(self.width, dtype=np.uint64)
        self.all = self.bits(np.arange(len(words)))

    def bits(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, dtype=np.uint64)
        np.bitwise_or.at(out, words >> 6, np.left_shift(np.uint64(1), (words & 63).astype(np.uint64)))
        return out

    def near(self, points: np.ndarray, k: int, front: bool) -> np.ndarray:
        """For queries of one length (a row of code points each), the words at one error, as bitsets: those that agree in the
        first ``k`` letters, or those that don't."""
        many, length = points.shape
        at = np.searchsorted(self.alphabet, points)
        code = np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points, at, len(self.alphabet))
        top = len(self.rows) - 1
        having = lambda i, j: self.table[self.rows[i, code[:, j]] if 0 <= i <= top else np.full(many, self.none)]
        exact = np.broadcast_to(self.all, (many, self.width))
        replaced, longer, shorter = (np.zeros((many, self.width), dtype=np.uint64) for _ in range(3))
        agree = exact
        for j in range(length):
            here = having(j, j)
            longer = (longer | exact) & having(j + 1, j)
            shorter = (shorter & having(j - 1, j)) | exact
            replaced = (replaced & here) | (exact & ~here)
            exact = exact & here
            if j == k - 1:
                agree = exact
        size = lambda n: self.of_length.get(n, self.no_word)
        found = (replaced & size(length)) | (shorter & size(length - 1)) | ((longer | exact) & size(length + 1))
        return found & agree if front else found & ~agree


def search(key: tuple, filed_words: pa.Table, queries: pa.Table) -> pa.Table:
    """``word``, ``n_near``, ``form_n`` and ``form`` of the queries that have a near word in the block."""
    side, kind = key[0].as_py(), key[1].as_py()
    parts: list[pa.Table] = []
    if filed_words.num_rows and queries.num_rows:
        order = pc.sort_indices(filed_words, [("n", "descending"), ("word", "ascending")])
        words, n = filed_words["word"].take(order), filed_words["n"].take(order)
        index = Index(words.to_pylist())
        sought = queries["sought"].combine_chunks()
        lengths = pc.utf8_length(sought).to_numpy()
        some = max(1, BATCH // index.width)
        for length in np.unique(lengths):
            if not any(length + d in index.of_length for d in (-1, 0, 1)):
                continue
            own = sought.take(pa.array(np.flatnonzero(lengths == length)))
            for lo in range(0, len(own), some):
                batch = own.slice(lo, some)
                points, _ = letters(batch.to_pylist())
                found = index.near(points.reshape(-1, length), min(kind + 2, 4), side == 0)
                many = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                hit = np.flatnonzero(many)
                first = (found[hit] != 0).argmax(axis=1)
                word = found[hit, first]
                best = pa.array(first * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)))
                parts.append(pa.table([batch.take(pa.array(hit)), pa.array(many[hit]), n.take(best), words.take(best)], names=["word", "n_near", "form_n", "form"]))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    return pa.concat_tables([t.cast(schema) for t in parts]) if parts else schema.empty_table()


def near_words(words: DataFrame, cell: int = CELL, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """For each of ``words`` (``word``, ``n``) that has near words: how many, and the most frequent one with its count. The sizes
    change how the work is dealt, and not what is found."""
    total = words.count()
    buckets = max(1, -(-total // cell))
    length = F.length("word")
    index = words.select("word", "n", F.explode(filed(F.col("word"), class_of(length), buckets)).alias("cell")).select("cell.*", "word", "n")
    kinds = F.array_distinct(F.transform(F.array(F.greatest(length - 1, F.lit(1)), length, length + 1), class_of))
    cells = F.flatten(F.transform(kinds, lambda kind: filed(F.col("word"), kind, buckets)))
    sought = words.select(F.col("word").alias("sought"), F.explode(cells).alias("cell")).select("cell.*", "sought")
    place = ["side", "kind", "bucket"]
    size = index.groupBy(place).agg(F.count("*").alias("words")).join(sought.groupBy(place).agg(F.count("*").alias("queries")), place)
    most = F.greatest(F.floor(F.lit(block) / F.pow(F.lit(2.0), F.greatest(F.col("kind") - 2, F.lit(0)))), F.lit(1))
    size = written(size.select(*place, F.ceil(F.col("words") / most).cast("int").alias("blocks"), F.ceil(F.col("queries") / F.lit(chunk)).cast("int").alias("chunks")), "spelling-cells")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    share = lambda n, word: F.pmod(F.xxhash64(F.lit(n), word), F.col(n)).cast("int")
    left = index.join(size, place).withColumn("block", share("blocks", "word")).withColumn("chunk", F.explode(each("chunks"))).select(*place, "block", "chunk", "word", "n")
    right = sought.join(size, place).withColumn("chunk", share("chunks", "sought")).withColumn("block", F.explode(each("blocks"))).select(*place, "block", "chunk", "sought")
    keys = [*place, "block", "chunk"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(search, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form`` (never null), whose links make no circle."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while now.where("moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return now.select("word", "root")


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of each of ``words`` (different ``word``, ``n``)."""
    words = written(words.select("word", "n"), "spelling-words")
    enough = F.col("form_n") >= times * F.col("n")
    both = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    both = written(both, "spelling-forms")
    return both.join(roots(both.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))

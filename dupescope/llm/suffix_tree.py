"""Operator 3: language-model scoring by a probabilistic suffix tree over words, beside a word-count baseline.

The symbols are the words in lower case and one end after each text. A context is what stands before a symbol: up to DEPTH
words, the first of which may be the beginning of the text. Sequences (a context and its next symbol) take part from LEAST
occurrences on, however large the corpus, so the tree grows with it. A context is retained if its next-symbol distribution
diverges from that of its longest proper suffix: the count times the Kullback-Leibler divergence must pay GAIN nats for each
number that it needs; the suffixes of a retained context stay with it. Distributions are smoothed towards those of the suffix,
down to the baseline's word probabilities (add 0.1, with one unknown word), so all of them sum to one. A text's score follows
the longest retained context at every token.

Counting takes two passes over all training texts, words and pairs first, then the longer sequences all of whose pairs pass.
A block of tokens sums its sequences and deals them out by ranges of their hash. Whether a pair passes is looked up in a bitmap
of fixed size: where bits are shared more candidates are counted, and none is lost. The tree is made by Spark joins.

What a token adds to the baseline is a sum: for each retained context before it, what it pays for leaving it, and for each of
them that the symbol is known after, the gain over the next shorter one and that payment back. So each sequence has one value
and a text's score is the sum over its sequences. The scoring pass carries the words and sequences of a share of P_MIN or
more (bounded in number); the others, none of them hot, are summed for each text and joined by Spark, with the rare words'
prices in the same join. Words and sequences are told apart by 64-bit hashes; a word's is a polynomial of its bytes, taken from
one running sum over all bytes of a run. A table that no later step reads is emptied when its last reader is written.

Defined results: a null text counts as empty: one token, the end; without training texts every word is unknown; rows with a
null id are training rows; repeated rows count and are scored once each; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupescope.llm.common import RUN_CHARS, bounded_batches, written
from dupescope.session import scratch_path

#: Words in a context, share of all tokens from which the scoring pass carries a word or sequence, gain in nats for each number,
#: weight of the suffix's distribution.
DEPTH, P_MIN, GAIN, PSEUDO = 3, 1e-6, 3.0, 1.0
#: Sequences of fewer occurrences never take part.
LEAST = 4
BEGIN, END = np.int64(-2), np.int64(-1)
#: Tokens whose sequences are summed together, and bits of a hash that a bitmap tells apart.
BLOCK_TOKENS, BITS = 1 << 20, 28
#: Parts, by key, in which the scoring pass's sequences are joined, one after the other; a power of two.
PARTS = 2


@dataclass
class Tokens:
    """Texts of a run as word hashes, each text with its begin and end; ``at``: places since the text's begin."""

    ids: np.ndarray
    at: np.ndarray
    many: np.ndarray  # words of each text


def table_of(change: dict[int, int], rest: np.ndarray) -> np.ndarray:
    rest = rest.copy()
    rest[list(change)] = list(change.values())
    return rest


LOWER = table_of({c: c + 32 for c in range(65, 91)}, np.arange(256, dtype=np.uint8))
INSIDE = table_of(dict.fromkeys([32, *range(9, 14)], 0), np.ones(256, dtype=bool))  # of a word
#: Of the polynomial of a word's bytes; how many bytes one running sum covers about.
BASE, SPAN = 0x9E3779B97F4A7C15, 1 << 17


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i below n."""
    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, x, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(low), SPAN)), len(starts)))
    for i, j in itertools.pairwise(cuts.tolist()):
        begin, end = int(starts[i]), int(ends[j - 1])
        up, down = powers(max(2 * SPAN, 1 << (end - begin).bit_length()))
        total = np.zeros(end - begin + 1, dtype=np.uint64)
        np.cumsum((low[begin:end].astype(np.uint64) + np.uint64(1)) * up[: end - begin], out=total[1:])
        at = starts[i:j] - begin
        out[i:j] = (total[ends[i:j] - begin] - total[at]) * down[at]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def tokens_of(texts: pa.Array) -> Tokens:
    """``texts``: strings with 64-bit offsets; nulls count as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)  # a byte outside on either side
    inside[1:-1] = INSIDE[data]
    edges = offsets[1:-1]
    starts = inside[1:-1] & ~inside[:-2]
    starts[edges[edges < len(data)]] |= inside[1:-1][edges[edges < len(data)]]
    ends = inside[1:-1] & ~inside[2:]
    ends[edges[edges > 0] - 1] |= inside[1:-1][edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    many = np.diff(np.searchsorted(starts, offsets))
    size = many + 2
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    ids = np.full(len(at), END)
    ids[first] = BEGIN
    ids[(at > 0) & (at < np.repeat(size - 1, size))] = word_hashes(LOWER[data], starts, ends)
    return Tokens(ids, at, many)


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about ``most`` bytes, and the place of the first; a longer text stands alone."""
    texts = texts.cast(pa.large_string())
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context and the next symbol."""
    x = context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def last_word(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The symbol that ``joined`` put after the context."""
    x = key.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    return (x - context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


class Lookup:
    """Places of keys among sorted ones, by a table of twice their number: a key stands at its home, given by its first bits, or as
    little behind it as the smaller keys allow."""

    def __init__(self, sorted_keys: np.ndarray):
        keys = sorted_keys.view(np.uint64)
        order = np.argsort(keys)
        self.bits = max(1, int(2 * len(keys)).bit_length())
        home = (keys[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        number = np.arange(len(keys))
        slot = np.maximum.accumulate(home - number) + number if len(keys) else home
        self.keys = np.zeros((1 << self.bits) + len(keys) + 2, dtype=np.uint64)
        self.place = np.full(len(self.keys), -1, dtype=np.int64)
        self.keys[slot], self.place[slot] = keys[order], order

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (0 where there is none), and whether a key is there."""
        sought = keys.view(np.uint64)
        at = (sought >> np.uint64(64 - self.bits)).astype(np.int64)
        going = np.flatnonzero((self.place[at] >= 0) & (self.keys[at] < sought))
        while len(going):
            at[going] += 1
            now = at[going]
            going = going[(self.place[now] >= 0) & (self.keys[now] < sought[going])]
        place = self.place[at]
        hit = (place >= 0) & (self.keys[at] == sought)
        return np.where(hit, place, 0), hit


def summed(keys: np.ndarray, contexts: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in the order of their unsigned values, a context of each, and the sums of ``n`` (or how many there are)."""
    order = np.argsort(keys.view(np.uint64))
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    many = np.diff(np.append(begin, len(keys))) if n is None else np.add.reduceat(n[order], begin) if len(keys) else n
    return keys[begin], contexts[order[begin]], many


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second bytes and so on, which Spark's compression shrinks."""
    return x.view(np.uint8).reshape(len(x), 8).T.tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def passes(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether a key may be in the bitmap: always, if it is."""
    at = keys.view(np.uint64) >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


#: Bits of Spark's bitmaps.
PAGE = 1 << 15


def bitmap_of(keys: DataFrame) -> list[tuple[int, bytes]]:
    """The first BITS bits of the column ``key``, as pages of 2 ** BITS bits that tasks compress."""
    bit = F.shiftrightunsigned("key", 64 - BITS)
    rows = keys.select(F.shiftright(bit, 15).alias("page"), bit.bitwiseAND(F.lit(PAGE - 1)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["page"], pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in b["bits"].to_pylist()], pa.binary())], names=["page", "bits"])

    got = rows.mapInArrow(compressed, "page bigint, bits binary").toArrow()
    return list(zip(got["page"].to_pylist(), got["bits"].to_pylist(), strict=True))


def bits_of(bitmap: list[tuple[int, bytes]]) -> np.ndarray:
    whole = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for page, bits in bitmap:
        whole[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(pa.decompress(bits, PAGE // 8, codec="zstd"), dtype=np.uint8)
    return whole


def sequences(ids: np.ndarray, at: np.ndarray, bitmap: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, keys and contexts of what a block counts: words and pairs, or with a bitmap of pairs the longer sequences."""
    if bitmap is None:
        yield 1, ids[at > 0], ids[at > 0]
    place = np.flatnonzero(at >= 1)
    key = np.zeros(len(ids), dtype=np.int64)
    key[place] = joined(ids[place - 1], ids[place])
    if bitmap is None:
        yield 2, key[place], ids[place - 1]
        return
    ok = np.zeros(len(ids), dtype=bool)
    ok[place] = passes(key[place], bitmap)
    for length in range(3, DEPTH + 2):
        place = place[(at[place] >= length - 1) & ok[place] & ok[place - 1]]
        longer, there = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        longer[place], there[place] = joined(key[place - 1], ids[place]), True
        yield length, longer[place], key[place - 1]
        key, ok = longer, there


def counts(training: DataFrame, bitmap: list[tuple[int, bytes]] | None = None, text_col: str = "text") -> DataFrame:
    """``length``, ``key``, ``context``, ``word`` and ``n``: all words and the pairs of LEAST occurrences or more, or with a bitmap
    of those pairs the longer sequences of as many."""
    bounded_batches(training.sparkSession)
    buckets = 16 * max(1, training.rdd.getNumPartitions())
    shared = training.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = None if shared.value is None else bits_of(shared.value)

        def ended() -> Iterator[pa.RecordBatch]:
            ids, at = (np.concatenate(x) for x in zip(*block, strict=True))
            block.clear()
            for length, *found in sequences(ids, at, pairs):
                keys, contexts, n = summed(*found)
                bucket = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                own = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if hi > lo]
                for i in range(0, len(own), 64):
                    some = own[i : i + 64]
                    data = [[planes(np.diff(keys[lo:hi], prepend=0)) for _, lo, hi in some], [planes(contexts[lo:hi]) if length > 1 else b"" for _, lo, hi in some], [planes(n[lo:hi]) for _, lo, hi in some]]
                    yield pa.record_batch([pa.array([length] * len(some), pa.int32()), pa.array([k for k, _, _ in some], pa.int64()), *(pa.array(x, pa.binary()) for x in data)], names=["length", "bucket", "keys", "contexts", "n"])

        size = 0
        for b in batches:
            for _, texts in pieces(b.column(0), 1 << 20):
                t = tokens_of(texts)
                block.append((t.ids, np.minimum(t.at, DEPTH).astype(np.int8)))
                size += len(t.ids)
                if size >= BLOCK_TOKENS:
                    yield from ended()
                    size = 0
        if block:
            yield from ended()

    def total(group: pa.Table) -> pa.Table:
        length = group["length"][0].as_py()
        keys = np.concatenate([np.cumsum(numbers(x)) for x in group["keys"].to_pylist()])
        contexts = np.concatenate([numbers(x) for x in group["contexts"].to_pylist()]) if length > 1 else keys
        keys, contexts, n = summed(keys, contexts, np.concatenate([numbers(x) for x in group["n"].to_pylist()]))
        if length > 1:
            keys, contexts, n = (x[n >= LEAST] for x in (keys, contexts, n))
        return pa.table([pa.array(np.full(len(keys), length, dtype=np.int32)), *(pa.array(x) for x in (keys, contexts, last_word(keys, contexts) if length > 1 else keys, n))], names=["length", "key", "context", "word", "n"])

    dealt = training.select(text_col).mapInArrow(task, "length int, bucket bigint, keys binary, contexts binary, n binary")
    return dealt.groupBy("length", "bucket").applyInArrow(total, "length int, key bigint, context bigint, word bigint, n bigint")


@contextmanager
def files_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the table that they were for is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the suffix of the context, becomes that of the sequence."""
    for b in batches:
        short, word = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("shorter", "word"))
        yield pa.record_batch([*b.columns[:-1], pa.array(joined(short, word))], names=[*b.schema.names[:-1], "suffix"])


class Tables:
    """Written tables of one run; ``free`` empties those that no later step reads, once what was made of them is written."""

    def __init__(self) -> None:
        self.paths: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str, *apart: str) -> DataFrame:
        """``apart``: columns whose values are kept in folders of their own."""
        path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
        df.write.partitionBy(*apart).parquet(path)
        read = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths.append((read, path))
        return read

    def free(self, *tables: DataFrame) -> None:
        for read, path in self.paths:
            if any(read is t for t in tables):
                read.sparkSession.createDataFrame([], read.schema).coalesce(1).write.mode("overwrite").parquet(path)


def tree_of(words: DataFrame, longer: DataFrame, texts: int, below: float, tables: Tables) -> DataFrame:
    """``key``, ``n`` and ``value`` of sequences of all lengths: what each occurrence adds to a text's score.
    ``words``: key and n; ``longer``: length, key, context, word and n."""
    spark = words.sparkSession
    begun = spark.createDataFrame([(int(BEGIN), texts)], "key bigint, n bigint")
    known = words.unionByName(begun).withColumn("chance", (F.col("n") + F.lit(0.1)) / F.lit(below)).withColumn("suffix", F.lit(None).cast("bigint"))
    levels = []  # by length of the context
    for length in range(2, DEPTH + 2):
        own = longer.where(F.col("length") == length).select("key", "context", "word", "n")
        of = own.groupBy("context").agg(F.sum("n").alias("followed")).join(known.select(F.col("key").alias("context"), F.col("n").alias("times"), F.col("suffix").alias("shorter")), "context")
        of = of.select("context", "times", "shorter", ((F.col("times") - F.col("followed") + F.lit(PSEUDO)) / (F.col("times") + F.lit(PSEUDO))).alias("left"))
        both = own.join(of, "context").select("key", "context", "n", "times", "left", "word", "shorter")
        if length == 2:
            both = both.withColumn("suffix", F.col("word")).drop("word")
        else:
            both = both.select("key", "context", "n", "times", "left", "word", "shorter", F.col("shorter").alias("suffix")).mapInArrow(suffixes, "key bigint, context bigint, n bigint, times bigint, left double, word bigint, shorter bigint, suffix bigint").drop("word")
        both = both.join(known.select(F.col("key").alias("suffix"), F.col("chance").alias("q")), "suffix")
        both = tables.put(both.withColumn("chance", F.col("n") / (F.col("times") + F.lit(PSEUDO)) + F.col("left") * F.col("q")), "model-tree")
        known = both.select("key", "n", "chance", "suffix")
        levels.append(both)
    values, longer_kept = [], None
    for both in reversed(levels):
        p, q = F.col("chance"), F.col("q")
        rest = [F.greatest(F.lit(1e-12), 1 - F.sum(x)) for x in (p, q)]
        diverges = F.first("times") * (F.sum(p * F.log(p / q)) + rest[0] * F.log(rest[0] / rest[1]))
        stats = both.groupBy("context").agg(*(F.first(c).alias(c) for c in ("times", "left", "shorter")), (diverges >= F.lit(GAIN) * (1 + F.count("*"))).alias("pays"))
        if longer_kept is not None:
            stats = stats.join(longer_kept.distinct().withColumn("longer", F.lit(True)), "context", "left").withColumn("pays", F.col("pays") | F.coalesce("longer", F.lit(False)))
        whole = tables.put(stats.where("pays").select("context", "times", "left", "shorter"), "model-contexts")
        longer_kept = whole.select(F.col("shorter").alias("context"))
        values.append(whole.select(F.col("context").alias("key"), F.col("times").alias("n"), F.log10("left").alias("value")))
        values.append(both.join(whole.select("context"), "context", "left_semi").select("key", "n", (F.log10(F.col("chance") / F.col("q")) - F.log10("left")).alias("value")))
    return reduce(DataFrame.unionByName, values).groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value"))


def fit(training: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, int, int]:
    """The values of sequences, all words with their counts, the number of tokens and of different words."""
    tables = Tables()
    first = tables.put(counts(training, None, text_col), "model-counts", "length")
    words = first.where("length = 1").select("key", "n")
    tokens, different, texts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("key") == int(END), F.col("n"))), F.lit(0))).first()
    pairs = first.where("length = 2")
    second = tables.put(counts(training, bitmap_of(pairs), text_col), "model-counts")
    values = written(tree_of(words, pairs.unionByName(second), texts, tokens + 0.1 * (different + 1), tables), "model-values")
    tables.free(*(t for t, _ in tables.paths if t is not first))
    return values, words, tokens, different


def by_text(text: np.ndarray, key: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """For each text its different keys, and how often it has them."""
    order = np.argsort(key)
    order = order[np.argsort(text[order].astype(np.uint16 if texts < 1 << 16 else np.int64), kind="stable")]
    text, key = text[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(text) else text
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, key[new]), pa.ListArray.from_arrays(ends, np.diff(np.append(new, len(text))).astype(np.int64))


def language_model_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", p_min: float = P_MIN) -> DataFrame:
    """A row for each document: the id column, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``. ``training``: a condition on ``docs``; ``p_min``: share from which the scoring pass carries words and sequences,
    which the result does not depend on."""
    with files_freed(docs.sparkSession):
        return scored_by(docs, training, id_col, text_col, p_min, *fit(docs.where(training), text_col))


def scored_by(docs: DataFrame, training: Column, id_col: str, text_col: str, p_min: float, values: DataFrame, words: DataFrame, tokens: int, different: int) -> DataFrame:
    below = float(np.log10(tokens + 0.1 * (different + 1)))
    hot = F.col("n") >= p_min * tokens  # DEPTH / p_min sequences at most, and 1 / p_min words
    columns = lambda df: [c.to_numpy() for c in df.toArrow().columns]
    own = hot | (F.col("key") == int(END))
    often, valued = columns(words.where(own).select("key", "n")), columns(values.where(hot).select("key", "value"))
    model = docs.sparkSession.sparkContext.broadcast((*often, *valued, bitmap_of(values)))
    longs = T.ArrayType(T.LongType())
    lists = [(f"keys{part}", f"times{part}") for part in range(PARTS)]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("row", "n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base", "gain")), *(T.StructField(c, longs) for both in lists for c in both)])
    unknown = float(np.log10(0.1)) - below

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many, valued, value, bitmap = model.value
        bitmap, often, valued = bits_of(bitmap), Lookup(keys), Lookup(valued)
        logs = np.log10(many + 0.1) - below
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, texts in pieces(b.column(1), RUN_CHARS):
                t, n = tokens_of(texts), len(texts)
                real, of = t.at > 0, np.repeat(np.arange(n), t.many + 2)
                text, word = of[real], t.ids[real]
                at, hit = often.find(word)
                known = np.bincount(text[hit], minlength=n)
                base = np.bincount(text[hit], weights=logs[at[hit]], minlength=n) + unknown * np.bincount(text[~hit], minlength=n)
                gain, key, others = np.zeros(n), t.ids, [(text[~hit], word[~hit])]  # rare words; of them values are joined, too
                for length in range(1, DEPTH + 2):
                    if length > 1:
                        key = np.concatenate([key[:1], joined(key[:-1], t.ids[1:])])
                    place = np.flatnonzero(t.at >= length - 1)
                    place = place[passes(key[place], bitmap)]
                    at, hit = valued.find(key[place])
                    gain += np.bincount(of[place[hit]], weights=value[at[hit]], minlength=n)
                    rest = place[~hit & (t.at[place] == 0)] if length == 1 else place[~hit]
                    others.append((of[rest], key[rest]))
                text, key = (np.concatenate(x) for x in zip(*others, strict=True))
                part = key.view(np.uint64) % np.uint64(PARTS)
                found = [x for p in range(PARTS) for x in by_text(text[part == p], key[part == p], n)]
                yield pa.record_batch([b.column(0).slice(lo, n), b.column(2).slice(lo, n), pa.array(row + np.arange(n)), pa.array(t.many + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(gain), *found], names=schema.names)
                row += n

    scored = written(docs.select(id_col, text_col, F.coalesce(~training, F.lit(False)).alias("held_out")).mapInArrow(task, schema), "model-scores")
    none = F.lit(0.0)
    prices = words.where(~own).select("key", F.lit(1).alias("known"), (F.log10(F.col("n") + 0.1) - F.lit(float(np.log10(0.1)))).alias("log"), none.alias("value"))
    prices = prices.unionByName(values.where(~hot).select("key", F.lit(0).alias("known"), none.alias("log"), "value"))
    sums = []
    for part, (keys, times) in enumerate(lists):  # the shuffle files of a part go before the next
        listed = scored.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("t")).select("row", "t.key", "t.times")
        priced = listed.join(prices.where(F.expr(f"pmod(key, {PARTS}) = {part}")), "key")
        sums.append(written(priced.groupBy("row").agg(*(F.sum(F.col("times") * F.col(c)).alias(c) for c in ("known", "log", "value"))), "model-sums"))
    added = reduce(DataFrame.unionByName, sums).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "log", "value")))
    whole = scored.drop(*(c for both in lists for c in both)).join(added, "row", "left").withColumn("base_score", F.col("base") + F.coalesce("log", none))
    return whole.select(id_col, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain") + F.coalesce("value", none)).alias("score"))

"""Word and report vectors (VEC-1..7, AGG-8, JOIN-11/12, UDF-1)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from dupescope.functions.hashing import TWO_32
from dupescope.operators import skipgram
from dupescope.operators.corpus import drop_rare_words, vocabulary, word_freq
from dupescope.operators.groups import GROUP_ROWS, Group, grouped
from dupescope.session import materialize


#: Bytes of vectors that a task draws, about.
DRAWN_BYTES = 8 << 20


def drawn(words, dim: int, seed: int = 42, centred: bool = False) -> np.ndarray:
    """The vectors of ``words`` as rows: the draws of ``hashing.four_draws``, read from whole digests."""
    groups = [f"|{g}".encode() for g in range((dim - 1) // 4 + 1)]
    heads = [(str(seed) if w is None else f"{seed}|{w}").encode() for w in words]
    md5 = hashlib.md5
    digests = b"".join([md5(head + g, usedforsecurity=False).digest() for head in heads for g in groups])
    u = np.frombuffer(digests, ">u4").reshape(len(heads), 4 * len(groups))[:, :dim] / TWO_32
    return (u - 0.5) / dim if centred else u


def random_vectors(vocab: DataFrame, dim: int = 300, seed: int = 42, centred: bool = False,
                   word_col: str = "word", parts: int | None = None) -> DataFrame:
    """VEC-1 (uniform [0,1) per word and dimension) / VEC-3 (``centred``:
    ``(u - 0.5) / dim``). Stateless hash draws: any partitioning, any retry
    gives the same vector. One digest gives four draws. Without ``parts`` the
    words are written first, as they are counted and drawn."""
    words = vocab.select(word_col)
    if parts is None:
        words = materialize(words)
        parts = drawn_parts(words.count(), dim)

    @F.pandas_udf("array<double>")
    def vector(batch: pd.Series) -> pd.Series:
        return pd.Series(list(drawn(batch, dim, seed, centred)), dtype=object)

    # a word becomes 8 * dim bytes: tasks are cut by what they make, not by the few bytes that they read
    return words.repartition(parts, word_col).select(word_col, vector(word_col).alias("vector"))


def drawn_parts(n_words: int, dim: int) -> int:
    """How many tasks draw ``n_words`` vectors."""
    return max(1, n_words * 8 * dim // DRAWN_BYTES)


#: Occurrences that a group adds, and documents that it hands on, at a time: their vectors stay in a core's cache.
ADDED = 1024


def _add(sums: np.ndarray, place: np.ndarray, vecs: np.ndarray, of: np.ndarray) -> None:
    """Adds the row ``of`` of ``vecs`` to the row ``place`` of ``sums``, for each occurrence."""
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    for at in range(0, len(place), ADDED):
        p = place[at:at + ADDED]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
        sums[p[begin]] += np.add.reduceat(vecs[of[at:at + ADDED]], begin, axis=0)


def _vector_batch(keys: pa.Array, vecs: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1])
    lists = pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel()))
    return pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), lists.cast(schema.field(1).type)], schema=schema)


class _Sums(Group):
    """Sums of a group's vectors, a row for each key. Without ``dim`` the first vector gives it."""

    def __init__(self, dim: int | None, draw: Callable[[list], np.ndarray] | None, schema: pa.Schema):
        super().__init__()
        self.dim, self.draw, self.schema, self.sums = dim, draw, schema, None

    def met(self, part: pa.RecordBatch) -> None:
        if self.sums is None:
            self.dim = self.dim or len(part.column("_v")[0])
            self.sums, self.weights = np.zeros((len(self.keys), self.dim)), np.zeros(len(self.keys))
        words = part.column("word")
        place, of = self.occurrences(words)
        if not len(place):
            return
        vecs = self.draw(words.to_pylist()) if self.draw else part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(words), self.dim)
        self.weights += np.bincount(place, minlength=len(self.weights))
        _add(self.sums, place, vecs, of)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.sums is None:
            return
        found = np.flatnonzero(self.weights)
        for lo in range(0, len(found), ADDED):
            part = found[lo:lo + ADDED]
            yield _vector_batch(self.keys.take(pa.array(part)), self.sums[part] / self.weights[part, None], self.schema)


def mean_vectors(docs: DataFrame, vectors: DataFrame, dim: int, key: str = "pos",
                 tokens_col: str = "tokens", out_col: str = "vector", draw: Callable[[list], np.ndarray] | None = None,
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """AGG-8 / VEC-5 / JOIN-11: mean of the vectors of a document's token
    occurrences that are in the vocabulary; zeros when none.

    Documents are dealt to groups of about ``group_rows`` with their tokens. A
    word meets a group once, so a vector is sent once to each group that has
    the word, not once to each occurrence; no occurrence is sent by itself. A
    group's sums stay in one task, and no sum is shuffled. With ``draw``
    (words to rows, as ``drawn``) ``vectors`` only lists the words that have
    one, and each group draws its words' vectors itself: none is stored or sent.
    """
    table = vectors.select("word", *([] if draw else [F.transform("vector", lambda x: x.cast("double")).alias("_v")]))
    out = StructType([docs.schema[key], StructField("_m", ArrayType(DoubleType()))])
    schema = to_arrow_schema(out)
    means = grouped(docs, table, lambda: _Sums(dim, draw, schema), out, key, tokens_col, group_rows)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return docs.join(means, key, "left").withColumn(out_col, F.coalesce(F.col("_m"), zeros)).drop("_m")


def overlay_pretrained(own: DataFrame, pretrained: DataFrame,
                       draw: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """JOIN-12: vocabulary = own words U pretrained words; the pretrained vector
    wins where present. Dimensions must agree (checked per row). With ``draw``
    (words to vectors of one size, of the own and of the pretrained words) both
    tables only list words: the overlay is settled on them, and each vector is
    drawn once and stays where it is drawn."""
    if draw:
        words = own.select("word", F.lit(True).alias("_own")).join(
            pretrained.select("word", F.lit(True).alias("_pre")), "word", "full_outer")
        words = materialize(words.select("word", F.col("_pre").isNotNull().alias("_pre")))
        own_words, pre_words = words.where(~F.col("_pre")), words.where("_pre")
        return draw[0](own_words).unionByName(draw[1](pre_words))
    j = own.select("word", F.col("vector").alias("_own")).join(
        pretrained.select("word", F.col("vector").alias("_pre")), "word", "full_outer")
    vec = F.coalesce(F.col("_pre"), F.col("_own"))
    bad = F.col("_own").isNotNull() & F.col("_pre").isNotNull() & (F.size("_own") != F.size("_pre"))
    return j.select("word", F.when(bad, F.raise_error(F.lit("vector sizes differ"))).otherwise(vec).alias("vector"))


#: Bytes of n-gram sums that a task holds, about.
GRAM_BYTES = 64 << 20


def subword_vectors(vectors: DataFrame, min_n: int = 3, max_n: int = 6, dim: int | None = None,
                    draw: Callable[[list], np.ndarray] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """VEC-4 (re-aimed FastText role): character n-grams (3..6) of ``<word>``
    get the mean vector of the words holding them; of ``wanted(gram)`` alone,
    if given.

    With ``draw`` (words to rows of ``dim`` numbers, as ``drawn``) ``vectors``
    only lists the words. N-grams that begin alike are dealt to one task with
    the words that hold them, and the words' vectors are drawn there: only
    words are sent. A word goes to a task for each of its beginnings at most,
    and a task holds the sums of its n-grams.
    """
    grams = word_grams(vectors, min_n, max_n, [] if draw else [array_to_vector("vector").alias("_v")])
    if wanted is not None:
        wanted = materialize(wanted.select("gram").distinct())
        grams = grams.join(wanted, "gram", "left_semi")
    if not draw:
        return grams.groupBy("gram").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("vector"))
    n = (grams.select("gram").distinct() if wanted is None else wanted).count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, n * 8 * dim // GRAM_BYTES, min(2 * cores, n // 256))
    out = StructType([grams.schema["gram"], StructField("vector", ArrayType(DoubleType()))])
    schema = to_arrow_schema(out)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, weight = {}, np.zeros((0, dim)), np.zeros(0)
        for batch in batches:
            words, found = batch.column("word").dictionary_encode(), batch.column("gram").dictionary_encode()
            vecs = draw(words.dictionary.to_pylist())
            at = np.array([place.setdefault(g, len(place)) for g in found.dictionary.to_pylist()], dtype=np.int64)[found.indices.to_numpy()]
            if len(place) > len(weight):
                more = max(len(place), 2 * len(weight)) - len(weight)
                total, weight = np.concatenate([total, np.zeros((more, dim))]), np.concatenate([weight, np.zeros(more)])
            weight += np.bincount(at, minlength=len(weight))
            _add(total, at, vecs, words.indices.to_numpy())
        names = list(place)
        for lo in range(0, len(names), ADDED):
            hi = min(lo + ADDED, len(names))
            yield _vector_batch(pa.array(names[lo:hi]), total[lo:hi] / weight[lo:hi, None], schema)

    # in order of words, a word's rows stand together and it is drawn once
    dealt = grams.repartition(parts, F.substring("gram", 1, min_n)).sortWithinPartitions("word")
    return dealt.select("word", "gram").mapInArrow(sums, out)


def word_grams(words: DataFrame, min_n: int = 3, max_n: int = 6, more: list[Column] | None = None) -> DataFrame:
    """(word, gram, ``more``): the different n-grams of each ``<word>``."""
    grams = _ngrams(F.concat(F.lit("<"), F.col("word"), F.lit(">")), min_n, max_n)
    return words.select("word", F.explode(F.array_distinct(grams)).alias("gram"), *(more or []))


def _ngrams(s: Column, min_n: int, max_n: int) -> Column:
    lens = F.sequence(F.lit(min_n), F.lit(max_n))
    fits = F.filter(lens, lambda n: n <= F.length(s))  # sequence() would count down for longer ones
    return F.flatten(F.transform(fits, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n))))


def oov_vectors(words: DataFrame, gram_vectors: DataFrame, min_n: int = 3, max_n: int = 6) -> DataFrame:
    """VEC-4: a word's vector = mean of its known n-gram vectors; words with no
    known n-gram get none. Words are dealt to groups with their n-grams, so a
    vector is sent once to each group, not once to each word that has it."""
    grams = F.array_distinct(_ngrams(F.concat(F.lit("<"), F.col("word"), F.lit(">")), min_n, max_n))
    table = gram_vectors.select(F.col("gram").alias("word"), F.transform("vector", lambda x: x.cast("double")).alias("_v"))
    out = StructType([words.schema["word"], StructField("vector", ArrayType(DoubleType()))])
    schema = to_arrow_schema(out)
    return grouped(words.select("word", grams.alias("_grams")), table, lambda: _Sums(None, None, schema), out, "word", "_grams")


def masked_mean_pool(tokens: DataFrame, key: str = "doc", vec_col: str = "vector", mask_col: str = "mask") -> DataFrame:
    """VEC-6: mean of token vectors under an attention mask, denominator
    floored at 1e-9 (rows: doc, token vector, mask 0/1)."""
    item = F.posexplode(F.transform(vec_col, lambda x: x.cast("double"))).alias("_i", "_x")
    sums = tokens.select(key, F.col(mask_col).cast("double").alias("_m"), item).groupBy(key, "_i").agg(
        (F.sum(F.col("_x") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("_x"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"])
                                 .alias("vector"))


#: Tokens of a group that trains alone between two means, about: some 85,000 different words, 200 MB of vectors.
GROUP_TOKENS = 1 << 19
#: Words that a group hands on at a time.
TRAINED = 2048


def train_word2vec(corpus: DataFrame, vector_size: int = 300, min_count: int = 1, epochs: int = 5,
                   seed: int = 42, tokens_col: str = "tokens", group_tokens: int = GROUP_TOKENS, rounds: int = 2) -> DataFrame:
    """VEC-2: word vectors by skip-gram with negative sampling, as (word, vector).

    Documents are dealt to groups. A group trains the vectors of its own words
    alone; after each round (``epochs / rounds`` passes) the vectors of a word
    become their mean over the groups that hold it, weighted by its
    occurrences there. The model is a table with a row for each group and
    word: neither the driver nor a task holds more of it than a group's words.
    """
    if min_count > 1:
        corpus = drop_rare_words(corpus.select(tokens_col), vocabulary(word_freq(corpus, tokens_col), min_count), tokens_col=tokens_col, min_count=min_count)
    # the table fixes the rows' numbers, and with them the groups and the order in each
    docs = materialize(corpus.select(F.monotonically_increasing_id().alias("_row"), F.col(tokens_col).alias("_tokens")))
    n = docs.agg(F.sum(F.greatest(F.size("_tokens"), F.lit(0)))).first()[0] or 0
    groups, rounds = max(1, -(-n // group_tokens)), max(1, min(rounds, epochs))
    docs = docs.withColumn("_g", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    cuts = [epochs * i // rounds for i in range(rounds + 1)]
    model = None
    for lo, hi in zip(cuts, cuts[1:]):
        model = _trained(docs, model, vector_size, seed, range(lo, hi), epochs, groups)
        if hi < epochs:
            model = _word_means(_by_word(model, groups), vector_size)
    model = materialize(model.select("word", "_n", "_in"))
    return _word_means(_by_word(model, groups), vector_size, last=True)


def _by_word(model: DataFrame, groups: int) -> DataFrame:
    return model.repartition(groups, "word").sortWithinPartitions("word", *(["_g"] if "_g" in model.columns else []))


def _trained(docs: DataFrame, model: DataFrame | None, dim: int, seed: int, epochs: range, of_epochs: int, groups: int) -> DataFrame:
    """(_g, word, _n, _in, _out) after ``epochs`` in each group: the word, its occurrences there, and both its vectors."""
    both = docs if model is None else docs.unionByName(model, allowMissingColumns=True)
    order = ["_row"] if model is None else [F.col("_row").isNull(), "_row", "word"]
    out, fresh = "_g int, word string, _n bigint, _in binary, _out binary", model is None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, g, group = [], None, None
        for batch in batches:
            g = batch.column("_g")[0].as_py() if g is None and len(batch) else g
            is_doc = batch.column("_row").is_valid()
            lists.append(batch.column("_tokens").filter(is_doc))
            if fresh or pc.all(is_doc).as_py():
                continue
            group = group or _Trained(lists, dim, seed)
            rows = batch.filter(pc.invert(is_doc))
            group.met(rows.column("word"), _floats(rows.column("_in"), dim), _floats(rows.column("_out"), dim))
        if g is None:
            return
        group = group or _Trained(lists, dim, seed)
        skipgram.train(group.codes, group.text, group.inside, group.outside, np.random.default_rng([seed, epochs.start, g]), epochs, of_epochs)
        for lo in range(0, len(group.words), TRAINED):
            words = group.words.slice(lo, TRAINED)
            hi = lo + len(words)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(words), pa.int32()), words, pa.array(group.count[lo:hi]),
                                              _bytes(group.inside[lo:hi]), _bytes(group.outside[lo:hi])], names=["_g", "word", "_n", "_in", "_out"])

    # a partition is a group
    return both.repartitionById(groups, F.col("_g")).sortWithinPartitions(*order).mapInArrow(learn, out)


class _Trained:
    """A group's tokens, and the vectors of its words."""

    def __init__(self, lists: list[pa.Array], dim: int, seed: int):
        lists = pa.concat_arrays(lists)
        tokens = lists.flatten()
        text = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        self.text = text[tokens.is_valid().to_numpy(zero_copy_only=False)]
        coded = tokens.drop_null().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.count = np.bincount(self.codes, minlength=len(self.words))
        self.inside = skipgram.first_vectors(self.words.to_pylist(), dim, seed)
        self.outside = np.zeros_like(self.inside)

    def met(self, words: pa.Array, inside: np.ndarray, outside: np.ndarray) -> None:
        at = pc.index_in(words, value_set=self.words).to_numpy()
        self.inside[at], self.outside[at] = inside, outside


def _bytes(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows, dtype="<f4")
    ends = np.arange(len(data) + 1, dtype=np.int32) * np.int32(4 * data.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)
    return np.frombuffer(column.buffers()[2], "<f4", len(column) * dim, ends[column.offset]).reshape(-1, dim)


def _word_means(model: DataFrame, dim: int, last: bool = False) -> DataFrame:
    """Rows in order of words, with the mean of the word's vectors in place of each; at ``last`` one (word, vector) a word."""
    kinds = ["_in"] if last else ["_in", "_out"]

    def means(part: pa.RecordBatch) -> pa.RecordBatch:
        word, n = part.column("word"), part.column("_n").to_numpy().astype(np.float32)
        new = np.concatenate([[True], pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(n, begin)[:, None]
        mean = [np.add.reduceat(_floats(part.column(k), dim) * n[:, None], begin, axis=0) / total for k in kinds]
        if last:
            ends = pa.array(np.arange(len(begin) + 1, dtype=np.int32) * np.int32(dim))
            return pa.RecordBatch.from_arrays([word.take(pa.array(begin)), pa.ListArray.from_arrays(ends, pa.array(mean[0].ravel().astype(np.float64)))], names=["word", "vector"])
        of = np.cumsum(new) - 1
        return pa.RecordBatch.from_arrays([part.column("_g"), word, part.column("_n"), *(_bytes(m[of]) for m in mean)], names=["_g", "word", "_n", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last word, which may go on
        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()[0]
            word = part.column("word")
            same = pc.equal(word, word[len(word) - 1]).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(same))
            if cut:
                yield means(part.slice(0, cut))
            held = part.slice(cut)
        if held:
            yield means(held)

    return model.mapInArrow(run, "word string, vector array<double>" if last else model.schema)


def encode_reports(docs: DataFrame, make_predict_fn, text_col: str = "text", batch_size: int = 64,
                   dim: int | None = None) -> DataFrame:
    """UDF-1 / VEC-7: external sentence encoder through ``predict_batch_udf``
    (Arrow batches); ``make_predict_fn`` loads the model once per worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    enc = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return docs.withColumn("vector", enc(F.col(text_col)))

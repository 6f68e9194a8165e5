"""Documents dealt to groups, each of which meets the table rows of its words once.

A join of (document, word) rows with a table of words sends every occurrence
by itself, and sends it back. Here a document goes to its group with all its
tokens, and only the group's distinct words go to the table and come back with
its columns. In the group's partition the documents stand first and the words
behind them, so a task holds a group's tokens and reads the words as a stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Documents of a group, about.
GROUP_ROWS = 16384


class Group:
    """A group's documents, then the words that the table has. Documents of the same key are one."""

    def __init__(self):
        self._keys, self._tokens, self._ready = [], [], False

    def add(self, part: pa.RecordBatch) -> None:
        self._keys.append(part.column("_k"))
        self._tokens.append(part.column("_tokens"))

    def ready(self) -> None:
        """Once all documents are here: ``keys``, ``words``, and the place (in ``keys``) and word of each occurrence, by word."""
        if self._ready:
            return
        self._ready = True
        coded = pa.concat_arrays(self._keys).dictionary_encode()
        lists = pa.concat_arrays(self._tokens)
        self.keys = coded.dictionary
        tokens = lists.flatten().dictionary_encode()
        self.words = tokens.dictionary
        place = np.repeat(coded.indices.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        codes = pc.fill_null(tokens.indices, len(self.words)).to_numpy()  # a null token is no word
        order = np.argsort(codes, kind="stable")
        self.place, self.count = place[order], np.bincount(codes, minlength=len(self.words) + 1)
        self.begin = np.cumsum(self.count) - self.count
        self._keys = self._tokens = None

    def coded(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, value_set=self.words).to_numpy()

    def occurrences(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents that hold ``words``, once for each occurrence, and which of the words each is."""
        codes = self.coded(words)
        size = self.count[codes]
        at = np.repeat(self.begin[codes] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.place[at], np.repeat(np.arange(len(codes)), size)

    def met(self, part: pa.RecordBatch) -> None:
        """Rows of the table, each for a word of this group."""
        raise NotImplementedError

    def result(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def grouped(docs: DataFrame, table: DataFrame, make: Callable[[], Group], schema: StructType, key: str = "pos",
            tokens_col: str = "tokens", group_rows: int = GROUP_ROWS) -> DataFrame:
    """The results of all groups. ``table``: ``word`` and other columns; a group gets the rows of its words."""
    n = docs.count()
    # two groups a core at least, if they have some rows
    groups = max(1, math.ceil(n / group_rows), min(2 * docs.sparkSession.sparkContext.defaultParallelism, n // 256))
    of = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
    own = docs.where(F.col(key).isNotNull()).select(of.alias("_g"), F.col(key).alias("_k"), F.col(tokens_col).alias("_tokens"))
    words = own.select("_g", F.explode("_tokens").alias("word")).distinct().join(table, "word")
    both = own.unionByName(words, allowMissingColumns=True).repartition(groups, "_g")
    both = both.sortWithinPartitions("_g", F.col("_k").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for batch in batches:
            of, is_word = batch.column("_g").to_numpy(), batch.column("_k").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(of.astype(np.int64) * 2 + is_word)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if of[lo] != now:
                    if group:
                        group.ready()
                        yield from group.result()
                    now, group = of[lo], make()
                part = batch.slice(lo, hi - lo)
                if is_word[lo]:
                    group.ready()
                    group.met(part)
                else:
                    group.add(part)
        if group:
            group.ready()
            yield from group.result()

    return both.mapInArrow(run, schema)

"""Operator 9: a quality classifier on statistics of the text.

Random Fourier features (cosines of random projections) of the standardised statistics approximate a Gaussian kernel. Ridge
weights solve the normal equations, which every partition of the labelled rows sums for itself before they are added up. The
ridge score is calibrated by isotonic regression over a fixed grid of scores, so the driver sees a matrix of the number of
features and the grid, whatever the number of rows. All labelled rows take part.

Defined results: a null text counts as empty; empty texts have statistics of their own kind (all zero) and are scored like any
other; null labels teach nothing; a labelled id that occurs twice, in either table, teaches once for each pair of rows; without
labels every score is 0.5; an empty table gives no rows. Only the text goes into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupescope.llm.common import bounded_batches, runs, word_lists, written

#: Characters of a text by kind, as bytes of UTF-8.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "stop": b".!?", "mark": b"!", "space": b" \t", "line": b"\n"}
STATISTICS = ["chars", "words", "word_length", "distinct", "top_word", "same_as_last", "repeat_pairs", "dup_lines", "line_words", *KINDS]
FEATURES, RIDGE, SEED = 256, 1.0, 11
#: Cells of the calibration grid, over ridge scores from -1 to 2.
GRID = 3000


def _shares(code: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes each text has, and how often its commonest one occurs."""
    different, most = np.zeros(n), np.zeros(n)
    if len(code):
        pairs = np.sort(text * (int(code.max()) + 1) + code)
        begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        own = pairs[begin] // (int(code.max()) + 1)
        different = np.bincount(own, minlength=n).astype(float)
        np.maximum.at(most, own, np.diff(np.append(begin, len(pairs))))
    return different, most


def statistics_of(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for lo, hi in runs(texts):
        n = hi - lo
        raw = pa.array([t or "" for t in texts[lo:hi]], type=pa.string())
        at = raw.offsets if hasattr(raw, "offsets") else None
        at = np.frombuffer(raw.buffers()[1], dtype=np.int32, count=n + 1).astype(np.int64) if at is None else at.to_numpy().astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8, count=int(at[-1])) if at[-1] else np.zeros(0, dtype=np.uint8)
        size = np.maximum(np.diff(at), 1)
        text_bytes, starts, ends, many = word_lists(texts[lo:hi])
        words = np.maximum(many, 1)
        text = np.repeat(np.arange(n), many)
        offsets = pa.py_buffer(np.append(starts, len(text_bytes) + 1).astype(np.int64).tobytes())
        code = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(text_bytes.tobytes() + b" ")).dictionary_encode().indices.to_numpy().astype(np.int64)
        different, most = _shares(code, text, n)
        next_same = text[1:] == text[:-1]
        same = np.bincount(text[1:][next_same & (code[1:] == code[:-1])], minlength=n)
        base = int(code.max(initial=0)) + 1
        pair_kinds, _ = _shares(np.unique(code[:-1] * base + code[1:], return_inverse=True)[1][next_same] if len(code) > 1 else code[:0], text[1:][next_same], n)
        lines = pc.split_pattern(raw, "\n")
        flat = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        per = np.diff(lines.offsets.to_numpy())
        line_kinds, _ = _shares(flat, np.repeat(np.arange(n), per), n)
        columns = [np.log1p(np.diff(at)), np.log1p(many), np.bincount(text, weights=ends - starts, minlength=n) / words, different / words, most / words, same / words]
        columns += [np.where(many > 1, 1 - pair_kinds / np.maximum(many - 1, 1), 0), 1 - line_kinds / np.maximum(per, 1), np.log1p(many / np.maximum(per, 1))]
        for kind in KINDS.values():
            is_kind = np.zeros(256, dtype=np.int64)
            is_kind[list(kind)] = 1
            columns.append(np.diff(np.concatenate([[0], np.cumsum(is_kind[data])])[at]) / size)
        out[lo:hi] = np.stack(columns, axis=1) * (np.diff(at) > 0)[:, None]
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibrated: np.ndarray  # by cell of the grid

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return self.calibrated[cells(expanded(statistics, self.mean, self.scale) @ self.weights)]


def expanded(statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    rng = np.random.default_rng(SEED)
    d = len(mean)
    w, b = rng.standard_normal((d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((statistics - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def cells(ridge: np.ndarray) -> np.ndarray:
    return np.clip(((ridge + 1) / 3 * GRID).astype(np.int64), 0, GRID - 1)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over the grid; between cells with rows the values are joined by straight lines."""
    used = np.flatnonzero(weight)
    if not len(used):
        return np.full(len(weight), 0.5)
    blocks: list[list[float]] = []  # weight, total, cells
    for i in used.tolist():
        blocks.append([weight[i], total[i], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, blocks[-1][2] + k]
    values = np.concatenate([np.full(int(k), t / w) for w, t, k in blocks])
    return np.clip(np.interp(np.arange(len(weight)), used, values), 0, 1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``x``, the statistics of each text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(statistics_of(texts.tolist())))

    return docs.select(F.col(id_col).alias("id"), measured(F.col(text_col)).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the documents that have a label."""
    y = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = written(statistics(docs, id_col, text_col).join(y, "id").select("x", "y"), "labelled-statistics")
    d = len(STATISTICS)
    moments = rows.agg(F.count("*"), *(f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.full(GRID, 0.5))
    mean, scale = np.array(moments[1::2], dtype=float), np.maximum(np.array(moments[2::2], dtype=float), 1e-6)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            if b.num_rows:
                z = expanded(b.column(0).flatten().to_numpy().reshape(-1, d), mean, scale)
                total += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.record_batch([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array([r.tobytes() for r in total])], names=["i", "row"])

    def added(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum([np.frombuffer(r) for r in part["row"]], axis=0).tobytes()]})

    lines = rows.mapInArrow(sums, "i int, row binary").groupBy("i").applyInPandas(added, "i int, row binary").orderBy("i").collect()
    both = np.stack([np.frombuffer(r.row) for r in lines])
    weights = np.linalg.solve(both[:, :-1] + RIDGE * np.diag([1.0] * FEATURES + [0.0]), both[:, -1])

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(cells(expanded(np.stack(x.to_numpy()), mean, scale) @ weights).astype(np.int32)) if len(x) else pd.Series([], dtype="int32")

    grid = rows.groupBy(cell("x").alias("cell")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # GRID rows at most
    weight, total = np.zeros(GRID), np.zeros(GRID)
    for r in grid:
        weight[r.cell], total[r.cell] = r.n, r.y
    return Model(mean, scale, weights, isotonic(weight, total))


def score(text: Column, model: Model, docs: DataFrame) -> Column:
    """0 to 1, higher: label 1 likelier."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(statistics_of(texts.tolist())))

    return scored(text)

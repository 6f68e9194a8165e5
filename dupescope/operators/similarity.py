"""Similarity joins (JOIN-1..9): every query against the history before it.

History rule (JOIN-1/SET-3): candidates of a query at position ``p`` are all
reports with ``pos < p`` -- training rows and earlier test rows alike -- so
the original "query, then append" loop becomes one join predicate.

Scorer output schema (UDF-2 protocol)::

    query_pos, query_id, cand_pos, cand_id, cand_disc, score, rank

One exact kernel scores word overlap, TF-IDF, dense vectors and their blend.
Both sides are prepared once: terms as 64-bit hashes, vectors at unit length.
They are dealt to a grid of query groups x history groups, whose numbers
follow from the measured bytes of each side, so every cell holds about
``CELL_BYTES`` of either. A row is sent once per group of the other side:
with history bytes H, query bytes Q and cell size B the grid moves 2*H*Q/B
bytes, whatever the number of queries. It moves them in rounds: each takes a
range of the history, all queries and about ``ROUND_BYTES``, writes its best
``n`` of each query and drops its shuffle, so the disk holds one round at a
time however the grid grows. A cell scores its pairs in chunks of bounded size
and hands on exactly the best ``n`` of each query (ties by position), a final
top-n merges cells and rounds, and ids are attached to the ranked rows alone. No pair is shuffled or sorted by Spark, and candidates that share
nothing with the query take part with score 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupescope.operators.positions import rank_within, top_n
from dupescope.session import materialize

SCORE_DIGITS = 10  # scores are compared after rounding: float sums differ by order
#: Bytes of history and of queries in a cell, and pairs scored at a time in it.
CELL_BYTES = 32 << 20
CHUNK_PAIRS = 1 << 21
#: Bytes of history that a cell has at least, if there are fewer cells than two a core.
LEAST_BYTES = 2 << 20
#: Bytes of both sides that the grid shuffles in a round, about.
ROUND_BYTES = 2 << 30

SCORED_SCHEMA = "query_pos bigint, cand_pos bigint, score double"


# ---------------------------------------------------------------- vector exprs
def dot(a, b) -> Column:
    """Inner product of two numeric arrays, in double."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """JOIN-4: unit length; a zero vector stays zero. The norm is bound to a
    lambda variable, so it is computed once per row, not per element."""
    unit = lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
    return F.transform(F.array(l2_norm(v)), unit)[0]


# ---------------------------------------------------------------- the kernel
#: A term of at least one in so many rows of a cell is a column of a matrix product; MATRIX_BYTES of them at most.
FREQUENT, MATRIX_BYTES = 24, 32 << 20
#: Postings of the other terms that are read at a time.
CHUNK_POSTINGS = 1 << 17


class Postings:
    """A cell's history by terms. Without weights a term weighs 1. ``scores`` are the sparse dot products of queries with all rows."""

    def __init__(self, lists: list[np.ndarray], weights: list[np.ndarray] | None):
        self.n = len(lists)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in lists])
        terms = np.concatenate(lists).astype(np.int64)
        order = np.argsort(terms, kind="stable")
        terms, self.rows = terms[order], rows[order]
        self.weights = None if weights is None else np.concatenate(weights).astype(np.float64)[order]
        begin = np.flatnonzero(np.concatenate([[len(terms) > 0], terms[1:] != terms[:-1]]))
        self.terms, self.begin = terms[begin], np.append(begin, len(terms))
        self.size = np.diff(self.begin)
        # counts of shared words are whole numbers, which are exact in single precision too
        kind = np.float32 if weights is None else np.float64
        most = max(1, MATRIX_BYTES // (max(1, self.n) * np.dtype(kind).itemsize))
        frequent = np.flatnonzero(self.size * FREQUENT >= self.n)
        if len(frequent) > most:
            frequent = np.sort(frequent[np.argsort(-self.size[frequent], kind="stable")[:most]])
        self.column = np.full(len(self.terms) + 1, -1)
        self.column[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.n), dtype=kind)
        for i, t in enumerate(frequent.tolist()):
            own = slice(self.begin[t], self.begin[t + 1])
            # a row may name a term more than once
            self.matrix[i] = np.bincount(self.rows[own], weights=None if weights is None else self.weights[own], minlength=self.n)

    def scores(self, q_terms: list[np.ndarray], q_weights: list[np.ndarray] | None) -> np.ndarray:
        """A row for each query, a column for each row of the history."""
        out = np.zeros((len(q_terms), self.n))
        sizes = [len(x) for x in q_terms]
        if not len(self.terms) or not sum(sizes):
            return out
        asked = np.concatenate(q_terms).astype(np.int64)
        gains = None if q_weights is None else np.concatenate(q_weights).astype(np.float64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.searchsorted(self.terms, asked)
        known = np.flatnonzero(self.terms[np.minimum(place, len(self.terms) - 1)] == asked)
        place, of, gains = place[known], of[known], None if gains is None else gains[known]
        column = self.column[place]
        dense = column >= 0
        if dense.any():
            mine = np.zeros((len(sizes), len(self.matrix)), dtype=self.matrix.dtype)
            np.add.at(mine, (of[dense], column[dense]), 1 if gains is None else gains[dense])
            out += mine @ self.matrix
        place, of, gains = place[~dense], of[~dense], None if gains is None else gains[~dense]
        size = self.size[place]
        done = np.cumsum(size)
        lo = 0
        while lo < len(place):  # whole queries, but one at least
            before = int(done[lo] - size[lo])
            hi = max(lo + 1, int(np.searchsorted(done, before + CHUNK_POSTINGS, "right")))
            first, last = of[lo], of[hi - 1]
            many, width = size[lo:hi], int(last - first) + 1
            at = np.repeat(self.begin[place[lo:hi]] - (done[lo:hi] - many - before), many) + np.arange(int(done[hi - 1]) - before)
            spot = np.repeat((of[lo:hi] - first) * self.n, many) + self.rows[at]
            if self.weights is None and gains is None:
                value = None
            else:
                value = np.repeat(np.ones(hi - lo) if gains is None else gains[lo:hi], many) * (1.0 if self.weights is None else self.weights[at])
            out[first:last + 1] += np.bincount(spot, weights=value, minlength=width * self.n).reshape(width, self.n)
            lo = hi
        return out


#: Maxima of so many scores each bound a query's n-th best from below.
STRIDE = 64


def _near_best(own: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores that can be among the best ``k`` after rounding, ascending; mostly few more than ``k``."""
    m = len(own) // STRIDE
    if not k or m < 2 * k:
        return np.arange(len(own))
    most = own[:m * STRIDE].reshape(STRIDE, m).max(axis=0)
    least = np.partition(most, m - k)[m - k]
    return np.flatnonzero(own >= least - max(2 * 10.0 ** -SCORE_DIGITS, abs(least) * 1e-14))


def _best(scores: np.ndarray, q_pos: np.ndarray, h_pos: np.ndarray, n: int, tie_ascending: bool):
    """The best ``n`` of each row (history in ascending position): row and column of each."""
    for i, earlier in enumerate(np.searchsorted(h_pos, q_pos).tolist()):
        own = scores[i, :earlier]
        if np.isnan(own.sum()):  # no number is no score
            own = np.where(np.isnan(own), -np.inf, own)
        near = _near_best(own, min(n, earlier))
        rounded = np.round(own[near], SCORE_DIGITS) + 0.0
        near, rounded = near[rounded > -np.inf], rounded[rounded > -np.inf]
        k = min(n, len(near))
        if k == len(near):
            yield i, near
            continue
        kth = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        top, ties = near[rounded > kth], near[rounded == kth]
        yield i, np.concatenate([top, ties[: k - len(top)] if tie_ascending else ties[len(ties) - (k - len(top)):]])


def _cell(n: int, w_dense: float, w_sparse: float, tie_ascending: bool, cell_bytes: int = CELL_BYTES):
    def ragged(column) -> list[np.ndarray]:
        return [np.asarray(x) for x in column]

    def score(hdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(hdf) and len(qdf):
            hdf = hdf.sort_values("cand_pos", kind="stable")
            h_pos, q_pos = hdf["cand_pos"].to_numpy(np.int64), qdf["query_pos"].to_numpy(np.int64)
            if w_dense:
                h_vec = np.stack(ragged(hdf["h_vec"])).astype(np.float64)
                q_vec = np.stack(ragged(qdf["q_vec"])).astype(np.float64)
                rows_in = max(1, cell_bytes // (8 * h_vec.shape[1] + 16))  # rows of either side in a cell
            if w_sparse:
                postings = Postings(ragged(hdf["h_terms"]), ragged(hdf["h_weights"]) if "h_weights" in hdf else None)
                q_terms, q_weights = ragged(qdf["q_terms"]), ragged(qdf["q_weights"]) if "q_weights" in qdf else None
            step = max(1, CHUNK_PAIRS // len(h_pos))
            for lo in range(0, len(q_pos), step):
                hi = min(lo + step, len(q_pos))
                s = postings.scores(q_terms[lo:hi], q_weights and q_weights[lo:hi]) if w_sparse else np.zeros((hi - lo, len(h_pos)))
                if w_sparse not in (0.0, 1.0):
                    s *= w_sparse
                if w_dense:
                    for a in range(lo, hi, rows_in):
                        for b in range(0, len(h_pos), rows_in):
                            s[a - lo:a - lo + rows_in, b:b + rows_in] += w_dense * (q_vec[a:min(a + rows_in, hi)] @ h_vec[b:b + rows_in].T)
                for i, top in _best(s, q_pos[lo:hi], h_pos, n, tie_ascending):
                    found.append((np.full(len(top), q_pos[lo + i]), h_pos[top], s[i, top]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_pos", "cand_pos", "score"), columns)))

    return score


def _sized(df: DataFrame, arrays: list[str]) -> tuple[int, int]:
    """Rows, and bytes of their array columns (one aggregate)."""
    width = sum((F.size(c).cast("bigint") * 8 for c in arrays), F.lit(16).cast("bigint"))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return r.n, r.b


def ranges(history: DataFrame, pos: str, groups: int, sent: int) -> tuple[list[tuple[int, int] | None], int]:
    """Ranges of the history's positions, one for each round in which the grid sends about ``ROUND_BYTES`` of its ``sent`` bytes (a
    single None: all at once), and how many of the ``groups`` of the history a range makes."""
    rounds = max(1, min(groups, -(-sent // ROUND_BYTES)))
    lo, hi = history.agg(F.min(pos), F.max(pos)).first() if rounds > 1 else (None, None)
    if lo is None:
        return [None], groups
    cuts = [lo + (hi + 1 - lo) * i // rounds for i in range(rounds + 1)]
    return [x for x in zip(cuts, cuts[1:]) if x[0] < x[1]], -(-groups // rounds)


def within(df: DataFrame, pos: str, span: tuple[int, int] | None) -> DataFrame:
    return df if span is None else df.where((F.col(pos) >= span[0]) & (F.col(pos) < span[1]))


def best_of_rounds(rounds: list[DataFrame], best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``best`` over the rows of all rounds. Of several, each is written with its own best rows, and its shuffle dropped, before the next."""
    if len(rounds) == 1:
        return best(rounds[0])
    written = [materialize(best(r).select(*r.columns)) for r in rounds]
    return best(reduce(DataFrame.unionByName, written))


def kernel_topk(queries: DataFrame, history: DataFrame, n: int, vec_col: str | None = None,
                terms_col: str | None = None, weights_col: str | None = None, w_sparse: float = 0.0,
                cosine_query: bool = True, cell_bytes: int = CELL_BYTES, tie_ascending: bool = True) -> DataFrame:
    """Exact top ``n`` of ``w_sparse * sparse + (1 - w_sparse) * dense`` for every query.

    Without ``weights_col`` a term weighs 1 (word overlap); without ``vec_col``
    the score is the sparse part alone. Smaller cells than ``CELL_BYTES`` are
    scored one by one, but sent that many bytes at a time, as their number
    grows with the square of the rows.
    """
    w_dense = (1.0 - w_sparse) if vec_col else 0.0

    def prepared(df: DataFrame, side: str, pos: str, unit: bool) -> tuple[DataFrame, list[str]]:
        cols = []
        if vec_col:
            cols.append((l2_normalize(F.col(vec_col)) if unit else F.transform(vec_col, lambda x: x.cast("double"))).alias(f"{side}_vec"))
        if terms_col:
            terms = F.array_distinct(terms_col) if weights_col is None else F.col(terms_col)
            cols.append(F.transform(terms, lambda t: F.xxhash64(t)).alias(f"{side}_terms"))
            if weights_col is not None:
                cols.append(F.transform(weights_col, lambda x: x.cast("double")).alias(f"{side}_weights"))
        out = df.select(F.col("pos" if side == "h" else "query_pos").alias(pos), *cols)
        return out, [c for c in out.columns if c != pos]

    h, h_arrays = prepared(history, "h", "cand_pos", True)
    q, q_arrays = prepared(queries, "q", "query_pos", cosine_query)
    n_h, b_h = _sized(h, h_arrays)
    n_q, b_q = _sized(q, q_arrays)
    sent = max(cell_bytes, CELL_BYTES)
    groups_h, groups_q = max(1, math.ceil(b_h / sent)), max(1, math.ceil(b_q / sent))
    groups_h = max(groups_h, min(2 * history.sparkSession.sparkContext.defaultParallelism, b_h // LEAST_BYTES))
    spans, in_part = ranges(h, "cand_pos", groups_h, b_h * groups_q + b_q * groups_h)
    q = materialize(q) if len(spans) > 1 else q
    score = _cell(n, w_dense, w_sparse, tie_ascending, cell_bytes)

    def ranked(part: DataFrame) -> DataFrame:
        # every group of one side meets every group of the other, in one cell
        h_cells = part.withColumn("hg", F.pmod(F.xxhash64("cand_pos"), F.lit(in_part))).withColumn(
            "qg", F.explode(F.sequence(F.lit(0), F.lit(groups_q - 1)).cast("array<bigint>")))
        q_cells = q.withColumn("qg", F.pmod(F.xxhash64("query_pos"), F.lit(groups_q))).withColumn(
            "hg", F.explode(F.sequence(F.lit(0), F.lit(in_part - 1)).cast("array<bigint>")))
        scored = (h_cells.groupBy("hg", "qg").cogroup(q_cells.groupBy("hg", "qg"))
                  .applyInPandas(lambda a, b: score(a, b), SCORED_SCHEMA))
        return scored.withColumn("_sr", F.round("score", SCORE_DIGITS))

    best = best_of_rounds([ranked(within(h, "cand_pos", x)) for x in spans], lambda df: top_n(df, n, "query_pos", "_sr", "cand_pos", tie_ascending=tie_ascending)).drop("_sr")
    ids = history.select(F.col("pos").alias("cand_pos"), F.col("id").alias("cand_id"), F.col("disc_id").alias("cand_disc"))
    named = best.join(ids, "cand_pos").join(queries.select("query_pos", "query_id"), "query_pos")
    return named.select("query_pos", "query_id", "cand_pos", "cand_id", "cand_disc", "score", "rank")


# ---------------------------------------------------------------- JOIN-2
def overlap_topk(queries: DataFrame, history: DataFrame, n: int, tokens_col: str = "tokens", **opts) -> DataFrame:
    """Word overlap |set(q) & set(c)|; ties by later position first."""
    return kernel_topk(queries, history, n, terms_col=tokens_col, w_sparse=1.0, tie_ascending=False, **opts)


# ---------------------------------------------------------------- JOIN-5
def tfidf_topk(queries: DataFrame, history: DataFrame, n: int, terms_col: str = "tf_terms",
               weights_col: str = "tf_weights", **opts) -> DataFrame:
    """TF-IDF cosine over L2-normed sparse vectors; ties by earlier position."""
    return kernel_topk(queries, history, n, terms_col=terms_col, weights_col=weights_col, w_sparse=1.0, **opts)


# ---------------------------------------------------------------- JOIN-3/6/7
def dense_topk(queries: DataFrame, history: DataFrame, n: int, vec_col: str = "vector",
               cosine_query: bool = False, **opts) -> DataFrame:
    """JOIN-3 (inner product with normalised history) / JOIN-6 (cosine)."""
    return kernel_topk(queries, history, n, vec_col=vec_col, cosine_query=cosine_query, **opts)


def blend_topk(queries: DataFrame, history: DataFrame, n: int, w: float = 0.3, vec_col: str = "vector",
               terms_col: str = "tf_terms", weights_col: str = "tf_weights", **opts) -> DataFrame:
    """JOIN-7: ``w * tfidf_cosine + (1 - w) * dense_cosine``, ties by position."""
    return kernel_topk(queries, history, n, vec_col=vec_col, terms_col=terms_col, weights_col=weights_col,
                       w_sparse=w, cosine_query=True, **opts)


# ---------------------------------------------------------------- JOIN-9
SCORERS = {"simple": dense_topk, "tf_idf": blend_topk, "intersection": overlap_topk}


def rank_by(approaches: str | list[str], queries: DataFrame, history: DataFrame, n: int,
            options: dict[str, dict] | None = None) -> DataFrame:
    """JOIN-9: rank by one or several scorers, by name; one output with an
    ``approach`` column. ``options`` holds a scorer's own arguments by name."""
    names = [approaches] if isinstance(approaches, str) else list(approaches)
    unknown = sorted(set(names) - set(SCORERS))
    if unknown or not names:
        raise ValueError(f"no scorer named {', '.join(unknown) or '(none given)'}; known: {', '.join(sorted(SCORERS))}")
    out = None
    for name in dict.fromkeys(names):
        ranked = SCORERS[name](queries, history, n, **(options or {}).get(name, {})).withColumn("approach", F.lit(name))
        out = ranked if out is None else out.unionByName(ranked)
    return out


# ---------------------------------------------------------------- JOIN-8
#: Rows of one side that a task meets in a bucket, and positions of equal query vectors that are sent as one.
BUCKET_ROWS, SAME = 4096, 1024


def _bucket(n: int):
    """The best ``n`` of each query of a bucket's cell; a node is a vector and the positions that have it."""

    def score(hdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(hdf) and len(qdf):
            firsts = [np.asarray(x, dtype=np.int64) for x in hdf["positions"]]
            positions, node = np.concatenate(firsts), np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
            h_vec = np.stack([np.asarray(x, dtype=np.float64) for x in hdf["vec"]])
            for own, vec in zip(qdf["positions"], qdf["vec"]):
                values = (h_vec @ np.asarray(vec, dtype=np.float64))[node]
                order = np.lexsort((positions, -np.round(values, SCORE_DIGITS)))
                ranked, of = positions[order], values[order]
                for p in np.asarray(own, dtype=np.int64):
                    top = np.flatnonzero(ranked < p)[:n]
                    found.append((np.full(len(top), p), ranked[top], of[top]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_pos", "cand_pos", "score"), columns)))

    return score


def lsh_dense_topk(queries: DataFrame, history: DataFrame, n: int, vec_col: str = "vector",
                   planes: int = 8, tables: int = 96, seed: int = 42, dim: int | None = None,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Approximate dense candidates (sign random projections) with an exact
    inner-product re-rank. Candidates still obey ``cand_pos < query_pos``.

    Two unit vectors at angle ``a`` share a table's key with probability
    ``(1 - a/pi)^planes``, so a neighbour is met with ``1 - (1 - that)^tables``
    and an unrelated pair (a = pi/2) with about ``tables / 2^planes`` of the
    tables. Equal vectors are one node: of the history with its first ``n``
    positions, as later ones can't be in any list, of the queries with up to
    ``SAME`` positions. A bucket of more than ``bucket_rows`` nodes on either
    side is dealt out as a grid of cells. A cell scores its pairs and hands on
    the best ``n`` of each query, so no pair of a bucket becomes a row.
    """
    d = dim or history.select(F.size(vec_col)).first()[0]
    normals = np.random.default_rng(seed).standard_normal((tables, planes, d))

    @F.pandas_udf("array<int>")
    def keys(vectors: pd.Series) -> pd.Series:
        v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors]) if len(vectors) else np.zeros((0, d))
        bits = np.einsum("nd,tpd->ntp", v, normals) > 0
        return pd.Series(list((bits @ (1 << np.arange(planes))).astype(np.int32)))

    def numbered(df: DataFrame, pos: str, vec: Column) -> DataFrame:
        """``place``: rank of a position among those of the same vector."""
        rows = df.select(F.col(pos).alias("pos"), vec.alias("vec")).withColumn("same", F.sha2(F.to_json("vec"), 256))
        return rank_within(rows, ["same"], ["pos"], "place")

    def filed(nodes: DataFrame) -> DataFrame:
        return nodes.select("same", "vec", "positions", F.posexplode(keys("vec")).alias("t", "key"))

    h = numbered(history, "pos", l2_normalize(F.col(vec_col))).where(F.col("place") < n)
    q = numbered(queries, "query_pos", F.transform(vec_col, lambda x: x.cast("double")))
    node = [F.first("vec").alias("vec"), F.sort_array(F.collect_list("pos")).alias("positions")]
    h = materialize(h.groupBy("same").agg(*node))
    q = materialize(q.groupBy("same", F.expr(f"place div {SAME}").alias("share")).agg(*node))
    h, q = filed(h), filed(q)
    sizes = h.groupBy("t", "key").agg(F.count(F.lit(1)).alias("nh")).join(q.groupBy("t", "key").agg(F.count(F.lit(1)).alias("nq")), ["t", "key"])
    sizes = materialize(sizes.select("t", "key", *(F.ceil(F.col(c) / F.lit(bucket_rows)).cast("int").alias(c) for c in ("nh", "nq"))))
    hashed = F.xxhash64("same", F.element_at("positions", 1))
    cell = lambda df, own, other, a, b: df.join(sizes, ["t", "key"]).withColumn(a, F.pmod(hashed, F.col(own)).cast("int")).withColumn(
        b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("t", "key", "hg", "qg", "vec", "positions")
    h_cells, q_cells = cell(h, "nh", "nq", "hg", "qg"), cell(q, "nq", "nh", "qg", "hg")
    score, place = _bucket(n), ["t", "key", "hg", "qg"]
    met = h_cells.groupBy(place).cogroup(q_cells.groupBy(place)).applyInPandas(lambda a, b: score(a, b), SCORED_SCHEMA)
    once = met.groupBy("query_pos", "cand_pos").agg(F.max("score").alias("score"))
    best = top_n(once.withColumn("_sr", F.round("score", SCORE_DIGITS)), n, "query_pos", "_sr", "cand_pos").drop("_sr")
    ids = history.select(F.col("pos").alias("cand_pos"), F.col("id").alias("cand_id"), F.col("disc_id").alias("cand_disc"))
    named = best.join(ids, "cand_pos").join(queries.select("query_pos", "query_id"), "query_pos")
    return named.select("query_pos", "query_id", "cand_pos", "cand_id", "cand_disc", "score", "rank")

"""Operator 10: near-duplicates by SimHash fingerprints, candidates by pigeonring filtering.

Fingerprints of 64 bits are seen as a ring of 16 segments of 4 bits. If two differ in at most 4 bits, then from some segment of
the ring on every chain of l segments differs in at most l * 4 / 16 bits: 3 segments not at all, 7 in one bit, 11 in two, 15 in
three. Candidates must pass that chain from one start; only they reach the full Hamming check.

The chain's first links are an equality, so Spark finds candidates by shuffling keys: 12 equal bits, then the next 7, 11 and 15
segments as one to three groups of 16 bits. With at most g differing bits up to group g, enough 8-bit halves are untouched; a
key holds the first 12 bits and ``depth`` such halves (2, 5 or 14 ways for each start). Longer keys part more fingerprints and
lose no pair either; ``depth`` follows the logarithm of their number.

Keys are sorted within partitions and compared there in blocks. A task gives the links of a key's fingerprints as a spanning
forest, so copies in thousands give rows in thousands, not all their pairs. A key of more than ``HOT`` fingerprints is not
compared: its members are handed on and get longer keys, each way of ``depth`` halves by those ways of ``depth + 1`` that
continue it, and after the last half by 3 of the 7 segments of 4 bits that are left (4 bits can touch 4 of them). These last
keys hold 48 of 64 bits, so 65,536 different fingerprints at most. Keys that a sample of the fingerprints shows to be hot get
longer before the shuffle; the sample settles only where a row goes, the links are the same.
Equal fingerprints are one node from the start. Components grow by alternating large and small stars, each step a written table.

Defined results: a null or wordless text has fingerprint zero, which links like any other; texts of fewer words than a shingle
have one shingle; rows with a null id get the smallest id of their component, or null if it has none; repeated rows each get
their row; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupescope.llm.common import bounded_batches, runs, word_lists, written

SEGMENTS, BITS, MOST = 16, 4, 4
#: Chain lengths at which a budget is reached, and the budget.
CHAIN = ((3, 0), (7, 1), (11, 2), (15, 3), (16, 4))
#: Groups of up to this many are compared pair by pair; larger ones by a search from member to member.
SMALL_GROUP = 16
#: Pairs compared at a time in a larger group.
BLOCK_PAIRS = 1 << 20
#: Fingerprints of one key that are compared in one task; keys of more are made longer.
HOT = 1 << 12
#: A fingerprint of more than this part of all documents has its component broadcast, so that it isn't hot in the last join.
HOT_SHARE = 1 << 10
#: Fingerprints, about, that are drawn to see which keys are hot.
SAMPLE = 1 << 16
#: A key: the start, the way, and 48 bits at most that must be equal. The longest keys have 35 ways to go on.
START_BIT, WAY_BIT, LAST_WAYS = 57, 48, 35
#: Hashes whose bits are counted at a time.
COUNT_HASHES = 1 << 17


def fingerprints_of(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text (unsigned 64-bit)."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in runs(texts):
        data, starts, ends, many = word_lists(texts[lo:hi])
        n = np.where(many >= shingle, many - shingle + 1, np.minimum(many, 1))
        text = np.repeat(np.arange(hi - lo), n)
        if not len(text):
            continue
        first = (np.cumsum(many) - many)[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        last = first + np.minimum(many, shingle)[text] - 1
        raw = data.tobytes()
        hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), dtype=np.uint64, count=len(text))
        ones = np.zeros((hi - lo, 64), dtype=np.int64)
        for at in range(0, len(hashes), COUNT_HASHES):
            bits = np.unpackbits(hashes[at : at + COUNT_HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own, begin = np.unique(text[at : at + COUNT_HASHES], return_index=True)
            ones[own] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[lo:hi] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """The id column and ``fp``: the fingerprint's 64 bits as a bigint."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(fingerprints_of(b.column(1).to_pylist(), shingle, seed).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(task, schema)


def untouched(depth: int) -> list[tuple[int, ...]]:
    """The sets of ``depth`` halves, among two for each of ``depth`` groups, of which the first g groups hold g at least."""
    return [c for c in combinations(range(2 * depth), depth) if all(sum(h < 2 * g for h in c) >= g for g in range(1, depth + 1))]


def _start() -> Column:
    return F.shiftrightunsigned("key", START_BIT)


def _turned(start: Column) -> Column:
    """The ring's 64 bits from segment ``start`` on."""
    by = (start * BITS).cast("int")
    return F.when(by == 0, F.col("fp")).otherwise(F.call_function("shiftleft", F.col("fp"), by).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), 64 - by)))


def _bits(at: int, many: int) -> Column:
    """``many`` bits of the turned ring from bit ``at`` on, counted from the highest."""
    return F.shiftrightunsigned("turned", 64 - at - many).bitwiseAND(F.lit((1 << many) - 1))


def _key(value: Column, way: int) -> Column:
    return value.bitwiseOR(F.shiftleft(F.col("start").cast("bigint"), START_BIT)).bitwiseOR(F.lit(way << WAY_BIT).cast("bigint"))


def _half(h: int) -> int:
    return 3 * BITS + 8 * h


def chain_keys(nodes: DataFrame, depth: int) -> DataFrame:
    """``key`` and ``fp``, a row for each key: start, way, and the bits that must be equal."""
    rings = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("start")).select("fp", "start", _turned(F.col("start")).alias("turned"))

    def key(way: int, halves: tuple[int, ...]) -> Column:
        value = _bits(0, 3 * BITS)
        for h in halves:
            value = F.shiftleft(value, 8).bitwiseOR(_bits(_half(h), 8))
        return _key(value, way)

    return rings.select(F.explode(F.array(*(key(w, halves) for w, halves in enumerate(untouched(depth))))).alias("key"), "fp")


def longer_keys(keyed: DataFrame, depth: int) -> DataFrame:
    """The rows of ``keyed`` (keys of ``depth`` halves) with each key continued in every way of ``depth + 1``. Fingerprints that
    share a key of ``depth + 1`` share the one that it continues, so a pair that links meets again."""
    ways = untouched(depth)
    after = {halves: w for w, halves in enumerate(untouched(depth + 1))} if depth < 3 else {}
    rows = keyed.select("fp", _start().alias("start"), F.shiftrightunsigned("key", WAY_BIT).bitwiseAND(F.lit((1 << START_BIT - WAY_BIT) - 1)).alias("way"), F.col("key").bitwiseAND(F.lit((1 << WAY_BIT) - 1)).alias("value"))
    rows = rows.select("fp", "start", "way", "value", _turned(F.col("start")).alias("turned"))

    if depth == 3:
        left = F.lit([[_half(h) + at for h in range(6) if h not in halves for at in (0, BITS)] + [64 - BITS] for halves in ways])
        three = F.lit([list(c) for c in combinations(range(7), 3)])
        rows = rows.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(LAST_WAYS - 1))))
        value = F.col("value")
        for k in range(3):
            at = F.get(F.get(left, F.col("way").cast("int")), F.get(F.get(three, F.col("sub")), F.lit(k)))
            value = F.shiftleft(value, BITS).bitwiseOR(F.call_function("shiftrightunsigned", F.col("turned"), 64 - BITS - at).bitwiseAND(F.lit((1 << BITS) - 1)))
        return rows.select(_key(value, 0).bitwiseOR(F.shiftleft(F.col("way") * LAST_WAYS + F.col("sub"), WAY_BIT)).alias("key"), "fp")

    def on(halves: tuple[int, ...]) -> Column:
        return F.array(*(_key(F.shiftleft("value", 8).bitwiseOR(_bits(_half(h), 8)), after[*halves, h]) for h in range(halves[-1] + 1, 2 * depth + 2) if (*halves, h) in after))

    every = F.coalesce(*(F.when(F.col("way") == w, on(halves)) for w, halves in enumerate(ways)))
    return rows.select(F.explode(every).alias("key"), "fp")


def hot_keys(keyed: DataFrame, n: int) -> DataFrame | None:
    """Keys that hold more than ``HOT`` of ``n`` fingerprints as a sample of about ``SAMPLE`` of them tells; None if there are none.
    At most 2048 for each start and way, since each needs 32 fingerprints of the sample at least."""
    if n <= HOT:
        return None
    rate = min(1.0, SAMPLE / n)
    drawn = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < rate * (1 << 40))
    hot = written(drawn.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > max(32.0, HOT * rate)).select("key"), "hot-keys")
    return None if hot.isEmpty() else hot


def depth_for(n: int) -> int:
    """So that a key of unrelated fingerprints holds about one or a few."""
    return 1 if n < 1 << 20 else 2 if n < 1 << 29 else 3


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether fingerprints pass the chain from ``start`` and, at its end, the Hamming check."""
    x = a ^ b
    by = (BITS * start).astype(np.uint64)
    turned = np.where(by > 0, (x << by) | (x >> ((np.uint64(64) - by) % np.uint64(64))), x)
    ok = np.ones(x.shape, dtype=bool)
    for length, budget in CHAIN:
        ok &= np.bitwise_count(turned >> np.uint64(64 - BITS * length)) <= budget
    return ok


def forest(members: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of a large group as all their links would."""
    left, ends = members, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, BLOCK_PAIRS // len(left))
            now, front = front[:step], front[step:]
            hit = linked(now[:, None], left[None, :], np.array(start))
            to = np.flatnonzero(hit.any(axis=0))
            ends.append((now[hit[:, to].argmax(axis=0)], left[to]))
            front = np.concatenate([front, left[to]])
            left = np.delete(left, to)
    if not ends:
        return members[:0], members[:0]
    return tuple(np.concatenate(x) for x in zip(*ends, strict=True))


def links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    size = end - begin
    found = []
    small = np.repeat(size <= SMALL_GROUP, size)
    for lag in range(1, int(min(SMALL_GROUP, size.max(initial=1)))):
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        at = at[linked(fps[at], fps[at + lag], keys[at] >> START_BIT)]
        found.append((fps[at], fps[at + lag]))
    found += [forest(fps[begin[g] : end[g]], int(keys[begin[g]] >> START_BIT)) for g in np.flatnonzero(size > SMALL_GROUP).tolist()]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (fps[:0], fps[:0])


def compared(keyed: DataFrame, most: int) -> DataFrame:
    """``u``, ``v`` and ``key``: links within keys of at most ``most`` fingerprints (key null), and the rows of larger keys as
    they came (v null). A task holds a batch and ``most`` members."""

    def rows(u: np.ndarray, v: np.ndarray | None, keys: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(u), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            none = pa.nulls(len(u[at]), pa.int64())
            yield pa.record_batch([pa.array(u[at].view(np.int64)), none if v is None else pa.array(v[at].view(np.int64)), none if keys is None else pa.array(keys[at])], names=["u", "v", "key"])

    def closed(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        large = np.repeat(np.diff(cuts) > most, np.diff(cuts))
        yield from rows(fps[large], None, keys[large])
        if not large.all():
            yield from rows(*links_of(keys[~large], fps[~large]), None)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, passed = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            if passed is not None:  # the key that was found too large goes on
                more = int(np.searchsorted(keys, passed, side="right"))
                yield from rows(fps[:more], None, keys[:more])
                keys, fps, passed = keys[more:], fps[more:], passed if more == len(keys) else None
                if not len(keys):
                    continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if whole:
                yield from closed(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
            if len(keys) > most:
                passed = int(keys[-1])
                yield from rows(fps, None, keys)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from closed(keys, fps)

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(task, "u bigint, v bigint, key bigint")


def links(nodes: DataFrame, n: int) -> DataFrame:
    """``u`` and ``v``: links that join the fingerprints ``fp`` (all different, ``n`` of them) as all links would."""
    depth = depth_for(n)
    keyed, found = chain_keys(nodes.select("fp"), depth), []
    for depth in range(depth, 5):
        last = depth == 4
        hot = None if last else hot_keys(keyed, n)
        cold = keyed if hot is None else keyed.join(F.broadcast(hot), "key", "left_anti")
        out = compared(cold, 1 << 16 if last else HOT)
        if n <= HOT:  # no key can be larger
            found.append(out.select("u", "v"))
            break
        out = written(out, f"links-{depth}")
        found.append(out.where("key IS NULL").select("u", "v"))
        large = out.where("key IS NOT NULL").select("key", F.col("u").alias("fp"))
        if last or (hot is None and large.isEmpty()):
            break
        if hot is not None:
            large = large.unionByName(keyed.join(F.broadcast(hot), "key", "left_semi").select("key", "fp"))
        keyed = longer_keys(large, depth)
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``u`` and ``v``: each node but the smallest of its component, and that smallest one. Large and small stars in turn; every
    step is written and compared by count and checksum."""

    def down(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(down(edges), name)
    last = state(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = down(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        now = written(down(small), name)
        last, before = state(now), last
        if last == before:
            break
    return now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """A row for each document: the id column, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by
    fingerprints that differ in at most 4 bits)."""
    prints = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("many")), "fingerprint-nodes")
    stars = components(links(nodes, nodes.count()))
    roots = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    rooted = roots.join(nodes, "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = nodes.join(rooted.join(least, "root").select("fp", "least"), "fp", "left").select("fp", "many", F.coalesce("least", "first").alias("component_id"))
    share = max(1, (nodes.agg(F.sum("many")).first()[0] or 0) // HOT_SHARE)
    named = written(named, "fingerprint-names")
    hot = F.broadcast(named.where(F.col("many") > share).select("fp", "component_id"))  # fewer than HOT_SHARE rows
    joined = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(named.select("fp", "component_id"), "fp"))
    return joined.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

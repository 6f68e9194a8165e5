"""Chat formatting, near-duplicates, nearest neighbours, the pipeline and the registered queries."""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dupescope.llm import chat, neighbours, simhash

SF = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    both = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", both), (-1, 1, "assistant", both), (1, 0, "a\nb<|", "x\\<|y<"), (1, 1, "a\nb<|", "|z\\"), (1, 1, None, None), (2, None, "assistant", "<"), (2, 2, "assistant", "\\|<\\/|"), (2, 2, "assistant", "\\|<\\/|"), (None, 1, "user", "<|im_sep|>")]
    rows += [(7, k, ("user", "assistant")[k // 2 % 2], f"turn {k}\n") for k in range(900)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, segments string")
    f = chat.format_chat(df)
    got = {r.conv_id: r for r in f.select("conv_id", "formatted", "segments", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(role, text) for _, role, text in want]
        assert got[conv].loss == "".join(text for _, role, text in want if role == "assistant")
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
    assert got[2].formatted.count("<|im_start|>") == 1 and got[7].formatted.count("<|im_start|>") == 450
    assert chat.format_chat(df.limit(0)).count() == 0


def test_fingerprints_by_bits(texts):
    def one(text):
        words = simhash_words(text)
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))

    def simhash_words(text):
        import re

        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))

    assert simhash.fingerprints_of(texts).tolist() == [one(t) for t in texts]


def brute_components(fps):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize(("depth", "hot", "sample"), [(1, 1 << 12, 1 << 16), (2, 1 << 12, 1 << 16), (3, 1 << 12, 1 << 16), (1, 3, 1), (1, 20, 1 << 16), (2, 3, 1), (3, 3, 100)])
def test_links_lose_nothing(spark, depth, hot, sample, monkeypatch):
    monkeypatch.setattr(simhash, "depth_for", lambda n: depth)
    monkeypatch.setattr(simhash, "HOT", hot)  # keys of more go on, down to the last ones
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 64)
    rng = random.Random(depth)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for fp in list(fps)[:20]:
        fps.update(flipped(rng, fp, n) for n in (1, 2, 3, 4, 4, 4, 5, 5, 6))
    centre = rng.getrandbits(64)
    fps.update(flipped(rng, centre, rng.randint(1, 3)) for _ in range(120))  # a large group that shares keys
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(nodes, len(fps)).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    place = {f: i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for u, v in edges:
        up[top(place[u])] = top(place[v])
    parts = lambda ids: {frozenset(i for i, x in enumerate(ids) if x == k) for k in set(ids)}
    assert parts([top(i) for i in range(len(fps))]) == parts(brute_components(fps))


def test_longer_keys_continue_every_pair():
    for depth in (1, 2):
        assert {w[:-1] for w in simhash.untouched(depth + 1)} == set(simhash.untouched(depth))


def test_many_fingerprints_under_one_key(spark, monkeypatch):
    """Different fingerprints with the same first 40 bits: no task compares more than HOT of a key, and no link is lost."""
    rng = np.random.default_rng(11)
    low = np.unique(rng.integers(0, 1 << 24, 6000))
    fps = np.unique(np.concatenate([low, low[:300] ^ (1 << 23), rng.integers(1 << 40, 1 << 62, 500)]).astype(np.int64))
    monkeypatch.setattr(simhash, "HOT", 128)
    sizes = []
    group = simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda keyed, most: sizes.append(most) or group(keyed, most))
    edges = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp bigint"), len(fps)).collect()}
    assert len(sizes) > 1 and max(sizes[:-1]) == 128
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    up = {int(f): int(f) for f in fps}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        up[top(u)] = top(v)
    roots = np.array([top(int(f)) for f in fps])
    a, b = np.nonzero(near)
    assert (roots[a] == roots[b]).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(7, 7)]
    got = {r.u: r.v for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 1 for k in range(200, 260)}}


def test_near_duplicates(docs, empty, texts):
    rows = simhash.near_duplicates(docs).collect()
    got = {r.doc_id: r for r in rows}
    fps = [int(got[i].fingerprint, 16) for i in range(len(texts))]
    own = brute_components(fps)
    assert [got[i].component_id for i in range(len(texts))] == [own.index(c) for c in own]
    assert got[0].fingerprint == "0" * 16 and got[0].component_id == 0
    assert simhash.near_duplicates(empty).count() == 0
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert simhash.near_duplicates(nameless).count() == len(texts)


def test_hilbert_curve_is_continuous():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = neighbours.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 3
    v = (centres[rng.integers(0, 30, 1500)] + rng.standard_normal((1500, 16))).astype(np.float32)
    v[500:1000] = v[500]  # one vector in a third of the rows
    rows = [(int(i), x.tolist(), "q") for i, x in enumerate(v)]
    rows += [(5000, None, "q"), (5100, [0.0] * 16, "q"), (5200, [float("nan")] * 16, "q"), (5300, [1.0] * 3, "q"), (None, [1.0] * 16, "q"), rows[0], (5400, [None] + [1.0] * 15, "q")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0, share=0.02, least=64, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 50))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        distance = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(1500), distance)) if i != q][:10]
        assert all(s == distance[i] for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len(set(want) & {i for _, i, _ in found})
        if 500 <= q < 1000:
            assert [i for _, i, _ in found] == want
    assert hit >= 0.9 * 10 * len(got)
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    few = neighbours.nearest(df.where("vec_id < 4"), F.lit(True)).collect()
    assert len(few) == 12


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    ids = [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF), "test-stage")
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.collect()})
        assert ids[-1] <= ids[-2] and kept.count() == len(ids[-1])
    before = [r for r in docs.collect() if r.doc_id in ids[2]]
    own = brute_components(simhash.fingerprints_of([r.text for r in before]).tolist())
    groups = {}
    for r, c in zip(before, own, strict=True):
        groups.setdefault(c, []).append(r.doc_id)
    assert ids[3] == {min(g) for g in groups.values()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == ids[3]
    odd = docs.limit(3).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    assert corpus_pipeline.near_duplicate_stage(spark, odd, SF).count() >= 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{(i * i + 3 * i) % 53}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (None, a), *[(None, c)] * 5, (None, d), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(got, key=lambda r: r.text) == [(3, a), (7, b), (None, c), (9, d)]


def test_stages_pass_columns_of_any_name_and_texts_without_languages(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{(i * i + 3 * i) % 53}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a, None, 111, 5), (2, a, None, 112, 6), (3, b, None, 113, 7), (4, None, None, 114, 8)], "doc_id bigint, text string, lang string, _row int, __ROW int")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == [(1, a, None, 111, 5), (3, b, None, 113, 7), (4, None, None, 114, 8)]
    assert corpus_pipeline.language_stage(spark, docs, SF).count() == 4  # nothing is learned, so nothing is rejected


def test_registered_queries_run(spark):
    from __spark_entry__ import queries
    from dupescope.llm.queries import REGISTRY

    assert [n.split("_")[0] for n in REGISTRY] == [f"op{i}" for i in range(1, 14)]
    for name in REGISTRY:
        assert queries()[name](spark, SF).count() > 0
    assert "pipeline" in queries()


def test_oracle_sql(spark):
    from dupescope.llm.queries import ORACLE_SQL, REGISTRY

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        rel = con.sql(sql)
        df = REGISTRY[name](spark, SF).select(*rel.columns)
        assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall()), name

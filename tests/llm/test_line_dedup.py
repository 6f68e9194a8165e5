"""Line deduplication against plain Python, with hot lines over many partitions, repeated and missing ids."""

import hashlib
import random

import pytest

from dupescope.llm import line_dedup, queries

WHITE = " \t\n\x0b\x0c\r"
LOW = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(WHITE).translate(LOW)


def expected(rows, least=10):
    """(id, text) rows -> (id, lines, dropped, kept text) for each row."""
    rank = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(k := key(x)) < least or min(holders[k], key=rank) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=lambda r: (rank(r[0]), *r[1:]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    hot, lines = "The same licence line.", [f"passage number {k} of all" for k in range(40)]
    out = []
    for i in rng.sample(range(1000), 300):
        own = [rng.choice([hot, rng.choice(lines), " \t" + rng.choice(lines).upper() + "\r", f"own {i} {rng.random()}", "short", ""]) for _ in range(rng.randint(0, 12))]
        out.append((i, "\n".join(own)))
    odd = [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "\x85 no white space, A-Z only É\nÉ"), (5004, "no white space, a-z only É\n\x85 NO white space, a-z only É"), (5005, hot + ("\n" + hot) * 4000), (5006, "exactly 10\nExactly 10"), (5007, "exactly 10\nnot nine "), (5008, "not nine"), (5009, "漢字漢字漢字漢字漢字\n"), (5010, "漢字漢字漢字漢字漢字")]
    return out + odd + [(7, "first text of seven\n" + hot), (7, "second text of seven\nfirst text of seven"), (7, "second text of seven\nfirst text of seven"), (None, hot + "\nonly where no id is"), (None, "only where no id is"), (-3, hot), (2000, None)]


def got(df):
    return sorted(((r["doc_id"], r["line_dedup"]["lines"], r["line_dedup"]["dropped"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_against_plain_python(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([("x", *r, 1, 2) for r in rows], "row string, doc_id bigint, text string, place int, lines int")  # names that the operator uses itself
        found = line_dedup.deduplicated(docs)
        assert found.columns == [*docs.columns, "line_dedup"]
        assert got(found) == expected(rows)
        assert {tuple(r) for r in found.select("row", "place", "lines").collect()} == {("x", 1, 2)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmaps_and_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    (row,) = line_dedup.keep_bitmaps(docs).where("doc_id = 5005").collect()
    assert (row["lines"], row["dropped"]) == (4001, 4001) and not line_dedup.unpacked(row["keep"], 4001).any() and len(row["keep"]) < 40
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    assert line_dedup.deduplicated(docs.where("text is null")).select("line_dedup.lines").distinct().collect() == [(1,)]
    short = {r["doc_id"]: r["line_dedup"]["dropped"] for r in line_dedup.deduplicated(docs, least=3).collect()}
    assert short[5008] == 1  # "not nine" stays in 5007


def test_query(spark, tmp_path, rows):
    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    spark.createDataFrame(unique, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in queries.op13_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert found == [(i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in expected(unique)]

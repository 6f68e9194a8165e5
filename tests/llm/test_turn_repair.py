"""Turn repair against a search over all edits, and its query against the contract written plainly."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from dupescope.llm import queries, turn_repair

GOOD, PREFIX = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")
HEADS = [tuple((r, "") for r in h) for n in range(3) for h in itertools.product(("user", "assistant"), repeat=n)]


def faults(rows):
    """(role, text) pairs -> blank, duplicate, truncated or None for each."""
    seen, out = set(), []
    for role, text in rows:
        body = (text or "").rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, letters and repaired rows: all edits of every row with up to two insertions before and behind, cheapest first."""
    bad, best, count = faults(rows), None, itertools.count()
    heap = [(0, 0, 0, "", ())]  # cost, order of entry, row, letters, repaired rows
    while heap and (best is None or heap[0][0] <= best[0]):
        cost, _, i, letters, out = heapq.heappop(heap)
        for head in HEADS:
            own, paid, said = out + head, cost + 2 * len(head), letters + "I" * len(head)
            roles = "".join((r or "?")[:1] or "?" for r, _ in own)
            if not PREFIX.fullmatch(roles):
                continue
            if i == len(rows):
                if GOOD.fullmatch(roles) and (best is None or (paid, said) < best[:2]):
                    best = paid, said, own
                continue
            role, text = rows[i]
            found = [(3, "D", ())]
            if bad[i] not in ("blank", "duplicate"):
                more = 1 if bad[i] else 0
                found += [(more, "K", ((role, text),)), *((2 + more, "R", ((r, text),)) for r in ("user", "assistant"))]
            for price, letter, row in found:
                heapq.heappush(heap, (paid + price, next(count), i + 1, said + letter, own + row))
    return best


def expected(rows):
    """The contract's columns of one conversation's rows (turn, role, text), in order."""
    bad = faults([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    first = [(r or "")[:1] for _, r, _ in rows]
    cost, audit, out = cheapest([r[1:] for r in rows])
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "", row[2] or "")


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)
    said = ["Yes.", "No!", "Why?", "and then", "  \t", "", "Ok. \n", "é.", "x", None]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "umpire"]
    out = {}
    for c in range(150):
        n = rng.randint(1, 5)
        out[c] = sorted(((rng.choice([None, *range(6)]) if rng.random() < 0.3 else k, rng.choices(roles, (6, 6, 3, 1, 1, 1, 1, 1))[0], rng.choice(said) if rng.random() < 0.6 else f"t{rng.random()}.") for k in range(n)), key=key)
    out[None] = [(None, "user", "Hi."), (3, "user", "Hi."), (9, "assistant", "Bye.")]
    return out


def test_repair_is_the_cheapest_and_least(spark, conversations):
    rows = [("x", t, r, c, text, 1) for c, all_ in conversations.items() for t, r, text in all_]
    random.Random(3).shuffle(rows)
    turns = spark.createDataFrame(rows, "kind string, turn int, role string, conv_id bigint, text string, back int")  # names that the operator uses itself
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in turn_repair.summaries(turn_repair.repaired_turns(turns)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got.keys() == conversations.keys()
        for c, all_ in conversations.items():
            assert got[c] == expected([(t, r, text) for t, r, text in all_]), (c, all_)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "So"), (1, 5, "user", "So"), (1, 6, "assistant", " ")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = [tuple(r) for r in turn_repair.repaired_turns(turns).collect()]
    assert got == [(1, 0, "K", None, 0, "user", "user", "Hi.", 0), (1, 1, "R", "truncated", 1, "user", "assistant", "So", 3), (1, 2, "D", "duplicate", 5, "user", "user", "So", 3), (1, 3, "D", "blank", 6, "assistant", "assistant", " ", 3)]
    assert turn_repair.repaired_turns(turns.limit(0)).count() == 0
    assert turn_repair.summaries(turn_repair.repaired_turns(turns.limit(0))).count() == 0


def test_conversation_over_many_batches(spark):
    """One conversation of 30,000 rows in Arrow batches of 1,000: rows of the user alone alternate for the least cost."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        n = 30_000
        turns = spark.range(n).selectExpr("7 AS conv_id", "id AS turn", "CASE WHEN id % 3 = 2 THEN 'assistant' ELSE 'user' END AS role", "concat('t', id, '.') AS text")
        (row,) = turn_repair.summaries(turn_repair.repaired_turns(turns)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # user, user, assistant: an answer is inserted between the two (2), cheaper than any deletion
    assert (row["cost"], row["audit"]) == (2 * n // 3, "KIKK" * (n // 3)) and row["gaps"] == 0 and row["illegal"] == n // 3


def query_expected(rows):
    """The query's rows from plain Python over (conv_id, turn, role, text)."""
    after = {}
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        after[conv] += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    none = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    return {c: expected(sorted(own, key=key)) if own else none for c, own in after.items()}


def test_query_on_given_and_odd_rows(spark, tmp_path, conversations):
    odd = [(c, t, r, text) for c, all_ in conversations.items() for t, r, text in all_]
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for k, rows in enumerate((odd, given)):
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("how", queries.F.lit("n")).write.parquet(str(tmp_path / f"{k}/conversations.parquet"))
        got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in queries.op11_turn_repair(spark, str(tmp_path / str(k))).collect()}
        assert got == query_expected(rows)

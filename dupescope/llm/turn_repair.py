"""Operator 11: repair of the turn structure of conversations with the fewest edits, by streams sorted twice.

The roles of a good conversation read ``(s?(ua)+)?`` by their initials: nothing, or user and assistant in turns, perhaps after
one system row. Each row may be kept (cost 0), given the role user or assistant (2) or deleted (3); a row of the role user or
assistant without text may be inserted anywhere (2). Blank rows and repeats must be deleted; a truncated row that stays
costs 1 more. Among the cheapest edits those win whose initials (D, I, K, R) in order come first in ASCII.

Rows go to partitions by conversation, once. There they are sorted three times, by text, by turn backwards and by turn, all by
Spark's sort, which spills. The first order finds repeats. Along the second a Python worker carries the dynamic program: the
cost of ending well from each of the four places in the pattern. It moves on by tables, since costs less their minimum take
few values, and gives each row its backpointers, the best edits from each place, in 16 bits. Along the third the worker
carries the place reached and follows the backpointers. So a worker holds some numbers and one Arrow batch however long
the conversation is, and what would be too much for memory, backpointers included, is spilled with the rows.
The next edit is fixed by place and letter, and no choice of edits of one row begins another, so letter by letter the
least choice gives the least string.

Defined results: rows stand by turn (null turns first), then role and text; a null text is blank; a null or empty role, or one of
another initial, is never kept; equal role and text make a repeat, nulls being equal; rows of a null id are a conversation;
an empty table gives no rows; other columns of the input are not read. A conversation passes one task, in order, as any
digest of its whole text must; its size bounds that task's time and not its memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupescope.llm.common import bounded_batches

#: White space ``[\x20\x09-\x0D]``, and what a whole text may end with.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Places in the pattern: nothing yet, after a system row, after a user row, after an assistant row (or at the good end).
START, SYSTEM, USER, ASSISTANT = range(4)
#: The next role that can be given or inserted at each place, and the place after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The place that a kept row of an initial (s, u, a) leads to.
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What is done at a row: insertions before it, then its own edit. In ASCII order; a third insertion never pays.
CHOICES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: Insertions after the last row.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
FAULTS = (None, "truncated", "blank", "duplicate")


def after(place: int, choice: str, initial: int) -> int | None:
    """The place after the edits of a row, or None where they don't fit."""
    for letter in choice:
        place = NEXT[place] if letter in "IR" else KEPT.get((place, initial)) if letter == "K" else place
        if place is None:
            return None
    return place


def moved(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """From the costs behind a row to those before it, less their minimum, and the row's backpointers.
    ``kind``: 3 x initial (s, u, a, other) + 0 for a whole row, 1 for a truncated one, 2 for one that must go."""
    initial, state = divmod(kind, 3)
    new, back = [], 0
    for place in range(4):
        best = None
        for k, choice in enumerate(CHOICES):
            if state == 2 and choice[-1] != "D" or (to := after(place, choice, initial)) is None:
                continue
            cost = costs[to] + INSERT * choice.count("I") + {"D": DELETE, "K": 0, "R": REROLE}[choice[-1]] + (TRUNCATED if state == 1 and choice[-1] != "D" else 0)
            if best is None or cost < best[0]:
                best = cost, k
        new.append(best[0])
        back |= best[1] << 4 * place
    return tuple(x - min(new) for x in new), back


def backwards(key: str) -> object:
    """For mapInArrow over rows with the last turn first: fills the last column with backpointers."""
    end = tuple(INSERT * TAIL[p] for p in range(4))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]] = {}
        of, costs = object(), end
        for b in batches:
            back = []
            for k, kind in zip(b[key].to_pylist(), b["kind"].to_pylist(), strict=True):
                if k != of:
                    of, costs = k, end
                if (step := known.get((costs, kind))) is None:
                    step = known[costs, kind] = moved(costs, kind)
                costs = step[0]
                back.append(step[1])
            yield pa.record_batch([*b.columns[:-1], pa.array(back, pa.int32())], names=b.schema.names)

    return task


def forwards(key: str, schema: pa.Schema) -> object:
    """For mapInArrow over rows with the first turn first: follows the backpointers and gives the edited rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place, at, begun = None, START, 0, False
        for b in batches:
            keys, kinds, backs = (b[c].to_pylist() for c in (key, "kind", "back"))
            out: list[tuple] = []  # row of the batch or None, conversation, number, edit, role or None, cost

            def put(row: int | None, letter: str, role: str | None, cost: int) -> None:
                nonlocal at
                out.append((row, of, at, letter, role, cost))  # noqa: B023
                at += 1

            def ended() -> None:
                nonlocal place
                for _ in range(TAIL[place]):
                    place = NEXT[place]
                    put(None, "I", ROLES[place], INSERT)  # noqa: B023

            for i, (k, kind, back) in enumerate(zip(keys, kinds, backs, strict=True)):
                if not begun or k != of:
                    if begun:
                        ended()
                    of, place, at, begun = k, START, 0, True
                choice = CHOICES[back >> 4 * place & 15]
                for _ in choice[:-1]:
                    place = NEXT[place]
                    put(None, "I", ROLES[place], INSERT)
                place = after(place, choice[-1], kind // 3)
                if choice[-1] == "D":
                    put(i, "D", None, DELETE)
                else:
                    put(i, choice[-1], ROLES[place] if choice[-1] == "R" else None, (REROLE if choice[-1] == "R" else 0) + (TRUNCATED if kind % 3 == 1 else 0))
            yield edited(b, out, schema)
        if begun:
            out = []
            for _ in range(TAIL[place]):
                place = NEXT[place]
                out.append((None, of, at, "I", ROLES[place], INSERT))
                at += 1
            yield edited(None, out, schema)

    return task


def edited(b: pa.RecordBatch | None, out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rows, of, at, letter, role, cost = zip(*out, strict=True) if out else [()] * 6
    index = pa.array(rows, pa.int32())
    column = lambda name: pa.nulls(len(out), schema.field(name).type) if b is None else b[name].take(index)
    text = column("text").to_pylist()
    was = column("was")
    role = [r if r is not None else w for r, w in zip(role, was.to_pylist(), strict=True)]
    fault = [None if f is None else FAULTS[f] for f in column("fault_no").to_pylist()] if b is not None else [None] * len(out)
    text = ["" if x is None and r is None else x for x, r in zip(text, rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(of, schema.field(0).type), pa.array(at, pa.int64()), pa.array(letter, pa.string()), pa.array(fault, pa.string()), column("turn"), was, pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(cost, pa.int64())], schema=schema)


def repaired_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All rows with their edits, and the inserted ones: the conversation's id, ``place`` (from 0, over all edits), ``edit``
    (D, I, K or R), ``fault`` (blank, duplicate, truncated or null), ``turn``, ``was`` (the role before), ``role``, ``text`` and
    ``cost``. Without the rows of edit D they are the repaired conversation. A conversation stands whole and in order in
    one partition. ``id_col`` must have another name than the columns above."""
    spark = turns.sparkSession
    bounded_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = turns.select(F.col(id_col), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("was"), F.col(text_col).cast("string").alias("text")).repartition(F.col(id_col))
    body = F.rtrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    again = F.row_number().over(Window.partitionBy(id_col, "was", "text").orderBy(F.col("turn").asc_nulls_first()))  # needs no shuffle
    first = F.substring(F.coalesce("was", F.lit("")), 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault: Column = F.when(body == "", 2).when(F.col("again") > 1, 3).when(~F.substring(body, -1, 1).isin(*ENDS), 1).otherwise(0)
    rows = rows.withColumn("again", again).withColumn("fault_no", fault.cast("int"))
    rows = rows.withColumn("kind", initial * 3 + F.least("fault_no", F.lit(2))).withColumn("back", F.lit(0))
    order = ["turn", "was", "text", "again"]
    down = rows.sortWithinPartitions(F.col(id_col), *(F.col(c).desc_nulls_last() for c in order))
    up = down.mapInArrow(backwards(id_col), down.schema).sortWithinPartitions(F.col(id_col), *(F.col(c).asc_nulls_first() for c in order))
    out = T.StructType([T.StructField(id_col, turns.schema[id_col].dataType), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("turn", turns.schema[turn_col].dataType), *(T.StructField(c, T.StringType()) for c in ("was", "role", "text")), T.StructField("cost", T.LongType())])
    return up.mapInArrow(forwards(id_col, to_arrow_schema(out)), out)


class Summary:
    """What is said of one conversation, kept up row by row."""

    def __init__(self, of: object):
        self.of, self.turns, self.first, self.last = of, 0, None, None
        self.faults = dict.fromkeys(FAULTS[1:], 0)
        self.illegal = self.cost = self.kept = 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def add(self, edit: str, fault: str | None, turn: int | None, was: str | None, role: str | None, text: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if turn is not None and (self.last is None or turn != self.last):
                self.turns += 1
                self.first, self.last = turn if self.first is None else self.first, turn
            if fault is not None:
                self.faults[fault] += 1
            initial = (was or "")[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
        if edit != "D":
            self.digest.update(("\n" * (self.kept > 0) + f"{role}:{text}").encode())
            self.kept += 1

    def row(self) -> tuple:
        gaps = int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0
        return self.of, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def summaries(edits: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row for each conversation of ``repaired_turns``, whose rows are read in the order in which they come: ``gaps`` in the
    numbers of its turns, rows by fault, ``illegal`` neighbours, ``cost``, ``audit`` (the letters of the edits) and the digest of
    the repaired conversation."""
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField(id_col, edits.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Summary | None = None
        for b in batches:
            done = []
            columns = [b[c].to_pylist() for c in (id_col, "edit", "fault", "turn", "was", "role", "text", "cost")]
            for of, *row in zip(*columns, strict=True):
                if now is None or of != now.of:
                    done += [now.row()] if now else []
                    now = Summary(of)
                now.add(*row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.row(), kinds, strict=True)], schema=kinds)

    return edits.mapInArrow(task, schema)

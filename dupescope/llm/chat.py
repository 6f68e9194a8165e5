"""Operator 4: chat formatting with Spark expressions alone.

The turns of a conversation are collected as structs and sorted; adjacent turns of the same role become one marked block by
array aggregation (each run's texts joined, with a separator mark between them, so that the turns can be told apart again):

    <|im_start|>role\\ntext<|im_sep|>text of the same role<|im_end|>\\n

Control strings inside texts are escaped reversibly: ``\\`` becomes ``\\\\``, then ``<|`` becomes ``<\\|`` (in roles also a line
feed ``<\\/|``). After a ``<`` the number of ``\\`` is then odd only in an escape, so undoing the steps backwards is exact.

``segments`` holds the formatted text in parts with the loss flag: true for the escaped text of each assistant turn.

Defined results: a null role or text counts as empty; null turns come first; turns of equal number are ordered by role, then
text; repeated rows are turns of their own; rows whose conversation id is null form one conversation; an empty table gives
no rows; other columns of the input are not read. A conversation becomes one string, as the format asks: its text must fit a
row (2 GB), whatever the number of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupescope.llm.common import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/|"), F.lit("\n")))


def _segments(turns: Column) -> Column:
    """Parts of the formatted text with their loss flag, in order."""

    def parts(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
        last = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
        tail = F.when(last, F.lit(END)).otherwise(F.lit(""))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")), F.struct(tail.alias("text"), F.lit(False).alias("loss")))

    return F.filter(F.flatten(F.transform(turns, parts)), lambda s: s["loss"] | (s["text"] != ""))


def format_chat(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id``, ``formatted`` and ``segments`` (array of text and loss flag)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.collect_list("t").alias("turns"))
    parted = turns.select("conv_id", let(F.sort_array("turns"), _segments).alias("segments"))
    return parted.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chat(formatted: Column) -> Column:
    """The turns (array of role and text) that a formatted conversation holds."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = block.substr(F.length(head) + 2, F.length(block))
        role = unescape_role(head.substr(F.lit(len(START) + 1), F.length(head)))
        return F.transform(F.split(body, f"\\Q{SEP}\\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, f"\\Q{END}\\E")
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss flag, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")

"""Seeded, stateless hash ``h(seed, a, b, ...)`` used wherever the original draws
random numbers. It depends only on its arguments, so every draw is the same on
retry, on any partitioning, and equals the DuckDB form used by the oracle.

Spark:  cast(conv(substr(md5(concat_ws('|', seed, a, b)), 1, 8), 16, 10) as bigint)
DuckDB: ('0x' || substr(md5(concat_ws('|', seed, a, b)), 1, 8))::BIGINT
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h(*parts, seed: int = 42) -> Column:
    """32-bit unsigned hash in [0, 2^32) as bigint."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def h60(*parts, seed: int = 42) -> Column:
    """60-bit unsigned hash as bigint, for draws from wide ranges."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*parts, seed: int = 42) -> Column:
    """Uniform draw in [0, 1)."""
    return h(*parts, seed=seed) / F.lit(TWO_32)


def h_sql(*parts: str, seed: int = 42) -> str:
    """The same hash as DuckDB SQL text (for oracles)."""
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {args})), 1, 8)) AS BIGINT)"


def h60_sql(*parts: str, seed: int = 42) -> str:
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {args})), 1, 15)) AS BIGINT)"


def uniform_sql(*parts: str, seed: int = 42) -> str:
    return f"({h_sql(*parts, seed=seed)} / 4294967296.0)"


def four_draws(*parts, seed: int = 42) -> Column:
    """Four uniform draws in [0, 1) from one digest ``md5(seed|parts)``: hex
    chars 1-8, 9-16, 17-24, 25-32. The last part counts the groups of four,
    so draw number ``i`` is draw ``i % 4`` of group ``i div 4``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts])
    read = lambda d: F.array(*(F.conv(F.substring(d, 8 * j + 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32) for j in range(4)))
    return F.transform(F.array(F.md5(text)), read)[0]


def uniform_lanes_sql(*parts: str, lane: str, seed: int = 42) -> str:
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts] +
                     [f"CAST(({lane}) // 4 AS VARCHAR)"])
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {args})), (({lane}) % 4) * 8 + 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")

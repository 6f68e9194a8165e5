"""Column-level building blocks (no Python UDFs)."""

from dupescope.functions.hashing import h, uniform  # noqa: F401

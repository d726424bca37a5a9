"""Seeded pseudo-random draws that depend on row keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, *parts) -> Column:
    """A 32-digit hex string; its lexicographic order is a uniform random order of the rows."""
    cols = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    cols += [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("/", *[c.cast("string") for c in cols]))


def draw_int(seed, *parts) -> Column:
    """A uniform integer in [0, 2**32)."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 8), 16, 10).cast("bigint")

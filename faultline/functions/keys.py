"""Repeatable pseudo-random keys.

``rand()`` depends on how rows happen to be partitioned, so a retried task would draw other
rows. These keys depend on the row's identity and a seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw_key(seed: int, *identity: Column) -> Column:
    """Hex digest that orders rows in a random but repeatable way (also computable in plain SQL)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in identity]))


def uniform(seed: int, *identity: Column) -> Column:
    """Repeatable number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 52)) / F.lit(float(1 << 52))

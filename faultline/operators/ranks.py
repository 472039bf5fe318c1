"""Exact ranks and draws without a global sort (F8, M1-M3).

A rank over all rows of a stratum would sort the majority class in one task. Rows are first
counted per (stratum, slice of the order key); the counts give each slice its offset, and only
rows inside a slice are sorted. Slices that lie entirely outside the wanted range are dropped
before the shuffle. Draws are cut into slices by their leading digits, numbers of any distribution by
splitters: approximate quantiles of each stratum, of which there are never more than ``SPLITTERS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.keys import draw_key
from faultline.functions.names import col, pick

_PREFIX = 4  # hex digits: up to 65,536 slices per stratum
SPLITTERS = 512  # a power of two


def rank_by(
    df: DataFrame,
    strata: Sequence[str],
    key: Column,
    slice_of: Column,
    out: str = "rank",
    at_most: Column | int | None = None,
) -> DataFrame:
    """1-based rank by ``key`` within ``strata``; ``slice_of`` must be monotonic in ``key``.

    With ``at_most`` only rows up to that rank come back (a number, or a column of ``df`` that is
    constant within a stratum).
    """
    rows = df.withColumns({"__key": key, "__slice": slice_of})
    cell = [*pick(strata), F.col("__slice")]
    along = Window.partitionBy(*pick(strata)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
        .select(*cell, F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__offset"))
    )
    if isinstance(at_most, int):
        offsets = offsets.filter(F.col("__offset") < at_most)
    ranked = rows.join(offsets, [*strata, "__slice"])
    inside = Window.partitionBy(*cell).orderBy("__key")
    ranked = ranked.withColumn(out, F.row_number().over(inside) + F.col("__offset"))
    if at_most is not None:
        ranked = ranked.filter(F.col(out) <= at_most)
    return ranked.select(*pick(df.columns), out)


def draw_rank(
    df: DataFrame, strata: Sequence[str], seed: int, identity: Sequence[Column], out: str = "rank",
    at_most: Column | int | None = None,
) -> DataFrame:
    """Rank in random but repeatable order within ``strata``."""
    key = draw_key(seed, *identity)
    return rank_by(df, strata, F.struct(key, *identity), F.substring(key, 1, _PREFIX), out, at_most)


def keep_first(df: DataFrame, n: int, seed: int, identity: Sequence[Column]) -> DataFrame:
    """Exactly ``min(n, rows)`` rows drawn without replacement."""
    if n <= 0:
        return df.filter(F.lit(False))
    everything = df.withColumn("__all", F.lit(0))
    return draw_rank(everything, ["__all"], seed, identity, "__rank", n).drop("__rank", "__all")


def _place(splitters: Column, value: Column) -> Column:
    """Number of splitters (ascending) up to ``value``, by halving."""
    steps, width = [], SPLITTERS
    while width:
        steps.append(width)
        width //= 2
    return F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), lambda at, w: F.when(
        (at + w <= F.size(splitters)) & (F.try_element_at(splitters, at + w) <= value), at + w).otherwise(at))


def value_rank(df: DataFrame, strata: Sequence[str], number: str, rows_of_slice: int = 1024, out: str = "rank") -> DataFrame:
    """Rank in ascending order of an integer column within ``strata``; equal numbers share a slice, nulls come first.

    A stratum has as many slices as it fills with ``rows_of_slice`` rows, ``SPLITTERS`` at most, whatever its numbers are.
    """
    value = col(number).cast("bigint")
    rows = df.withColumn("__value", value)
    cuts = rows.groupBy(*pick(strata)).agg(
        F.percentile_approx("__value", F.array(*[F.lit(i / SPLITTERS) for i in range(1, SPLITTERS)]), F.lit(10_000)).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    # every step-th quantile of a small stratum
    step = F.greatest(F.lit(1), F.ceil(F.lit(SPLITTERS * rows_of_slice) / F.col("__n"))).cast("int")
    cuts = cuts.select(*pick(strata), F.array_distinct(F.filter("__cuts", lambda x, i: (i + 1) % step == 0)).alias("__cuts"))
    same = [rows[s].eqNullSafe(cuts[s]) for s in strata]
    joined = rows.join(cuts, same, "left").select(rows["*"], "__cuts")
    slice_of = F.when(F.col("__value").isNotNull(), _place(F.coalesce("__cuts", F.array().cast("array<bigint>")), F.col("__value"))).otherwise(-1)
    return rank_by(joined, strata, F.struct("__value"), slice_of, out).select(*pick(df.columns), out)

"""Uniform time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from faultline.functions.names import col, pick
from faultline.functions.times import MICROS, epoch_us, from_epoch_us
from faultline.operators.ordered import scan
from faultline.session import settle

DAY_SECONDS = 86_400
_CHUNK = 4096  # grid points generated per row of the chunk table


def grid(bounds: DataFrame, keys: Sequence[str], step_us: int, low: str = "low", high: str = "high") -> DataFrame:
    """All points ``low, low+step, ... <= high`` (column ``at``) per key.

    Points are generated from chunk rows that are spread over the cluster first, so a
    machine with years of data is not expanded from one row in one task.
    """
    chunk = step_us * _CHUNK
    chunks = bounds.select(
        *pick(keys), F.col(high).alias("__high"),
        F.explode(F.sequence(F.col(low), F.col(high), F.lit(chunk))).alias("__from"),
    ).repartition(*pick(keys), F.col("__from"))
    last = F.least(F.col("__high"), F.col("__from") + F.lit(chunk - step_us))
    return chunks.select(*pick(keys), F.explode(F.sequence(F.col("__from"), last, F.lit(step_us))).alias("at"))


def resample_last(
    df: DataFrame,
    seconds: int,
    columns: Sequence[str],
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
) -> DataFrame:
    """C4: row *t* of the grid holds, per column, the last non-null value in ``[t-seconds, t)``.

    Every bin from the first to the last timestamp gives one row; the first is therefore
    empty and the content of the last bin is not shown. Values of equal time
    are decided by the larger one. Bins start at midnight of the first day, which for a width dividing the day is the same as bins since 1970.
    """
    step = int(seconds * MICROS)
    us = epoch_us(col(ts))
    if DAY_SECONDS % seconds == 0:
        source = df.withColumn("__start", us - F.pmod(us, F.lit(step)))
    else:
        day = F.lit(DAY_SECONDS * MICROS)
        origin = settle(df.groupBy(*pick(keys)).agg(F.min(us).alias("__first")), "origins")  # a row per machine, sent to the rows
        source = (
            df.join(origin, list(keys))
            .withColumn("__origin", F.col("__first") - F.pmod(F.col("__first"), day))
            .withColumn("__start", us - F.pmod(us - F.col("__origin"), F.lit(step)))
        )
    bins = source.groupBy(*pick(keys), "__start").agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.struct(us, col(c)))).alias(c) for c in columns]
    )
    bounds = source.groupBy(*pick(keys)).agg(F.min("__start").alias("low"), F.max("__start").alias("high"))
    shown = bins.withColumn("at", F.col("__start") + F.lit(step)).drop("__start")
    return (
        grid(bounds, keys, step)
        .join(shown, [*keys, "at"], "left")
        .select(*pick(keys), from_epoch_us(F.col("at")).alias(ts), *pick(columns))
    )


def resample_asof(
    df: DataFrame,
    seconds: int,
    columns: Sequence[str],
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
) -> DataFrame:
    """Grid from the first timestamp on; each point takes the newest whole row at or before it.

    Rows are first reduced to the newest one per grid step (combined before the shuffle),
    then empty steps look back with the two-level scan.
    """
    step = int(seconds * MICROS)
    bounds = settle(df.groupBy(*pick(keys)).agg(F.min(epoch_us(col(ts))).alias("low"), F.max(epoch_us(col(ts))).alias("high")), "bounds")
    us = epoch_us(col(ts))
    since = us - F.col("low")
    up = F.pmod(F.lit(step) - F.pmod(since, F.lit(step)), F.lit(step))  # to the next grid point
    newest = (
        df.join(bounds.select(*pick(keys), "low"), list(keys))
        .groupBy(*pick(keys), (us + up).alias("at"))
        .agg(F.max_by(F.struct(*pick(columns)), F.struct(us, F.struct(*pick(columns)))).alias("__row"))
    )
    points = grid(bounds, keys, step).join(newest, [*keys, "at"], "left")
    filled = scan(points, keys, "at", last={"__row": F.col("__row")}, slot_us=F.col("at"), slot_seconds=seconds * 512)
    return filled.select(*pick(keys), from_epoch_us(F.col("at")).alias(ts), *[F.col("__row")[c].alias(c) for c in columns])

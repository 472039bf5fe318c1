"""Reading windows: interval joins, metadata, empty windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from faultline.functions.names import col, pick
from faultline.functions.times import bucket, epoch_us, from_epoch_us, shift
from faultline.params import Horizon
from faultline.session import settle

SALTS = 8
#: Most touched cells whose list is sent to all tasks (some 10 MB).
TOUCHED = 250_000
_CELL = "__cell"


def interval_join(
    samples: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    low: str,
    high: str,
    width_seconds: float,
    high_inclusive: bool = True,
    salts: int = SALTS,
    how: str = "inner",
) -> DataFrame:
    """Pairs (sample, interval) of one key with ``low <= ts <= high`` (or ``< high``).

    Written as a plain range condition this becomes a nested-loop join. Here each interval is
    repeated for the few cells of ``width_seconds`` it touches and the join is an equi-join on
    (keys, cell); a sample lies in exactly one cell, so no pair appears twice. The
    interval side is also repeated over ``salts``, which spreads one crowded cell over as
    many tasks; samples are never repeated. ``how='left'`` keeps intervals without samples.

    Before any shuffle, samples outside of all intervals go: those before the first or behind the last by a filter on ``ts``
    that reaches the scan, and, unless the intervals touch more than ``TOUCHED`` cells, those in other cells by a join with
    the touched ones, whose list is then sent to all tasks. Intervals are written once.
    """
    width = max(width_seconds, 1e-6)
    kept = intervals.columns
    intervals = settle(intervals, "intervals")
    first, final = bucket(epoch_us(col(low)), width), bucket(epoch_us(col(high)), width)
    head, tail = intervals.agg(F.min(epoch_us(col(low))), F.max(epoch_us(col(high)))).first()
    if head is None:
        pairs = samples.join(intervals, list(keys)).filter(F.lit(False))
        return pairs if how == "inner" else pairs.unionByName(intervals, allowMissingColumns=True)
    spread = intervals.withColumn(_CELL, F.explode(F.sequence(first, F.greatest(first, final))))
    given = samples.filter((col(ts) >= from_epoch_us(F.lit(head))) & (col(ts) <= from_epoch_us(F.lit(tail))))
    placed = given.withColumn(_CELL, bucket(epoch_us(col(ts)), width))
    touched = settle(spread.select(*pick(keys), _CELL).distinct(), "touched-cells")
    if touched.count() <= TOUCHED:
        placed = placed.join(F.broadcast(touched), [*keys, _CELL], "left_semi")
    spread = spread.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = placed.withColumn("__salt", F.pmod(F.xxhash64(*pick(samples.columns)), F.lit(salts)).cast("int"))
    within = (col(ts) >= col(low)) & ((col(ts) <= col(high)) if high_inclusive else (col(ts) < col(high)))
    pairs = placed.join(spread, [*keys, _CELL, "__salt"]).filter(within).drop(_CELL, "__salt")
    if how == "inner":
        return pairs
    missed = intervals.join(pairs.select(*pick(kept)).distinct(), kept, "left_anti")
    return pairs.unionByName(missed, allowMissingColumns=True)


def with_windows(examples: DataFrame, horizon: Horizon, ts: str = "ts") -> DataFrame:
    """bounds of the reading window and its length."""
    return examples.withColumns({
        "window_start": shift(col(ts), -horizon.reach),
        "window_end": shift(col(ts), -horizon.pw),
        "window_length": F.lit(horizon.rw),
    })


def for_horizons(examples: DataFrame, horizons: Sequence[Horizon], ts: str = "ts") -> DataFrame:
    """every example once per (PW, RW), all in one frame, so that one job serves all pairs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h.pw).alias("pw"), F.lit(h.rw).alias("rw")) for h in horizons]))
    spread = examples.withColumn("__h", pairs).select("*", "__h.*").drop("__h")
    return spread.withColumns({
        "window_start": shift(col(ts), -(F.col("pw") + F.col("rw"))),
        "window_end": shift(col(ts), -F.col("pw")),
        "window_length": F.col("rw"),
    })


def window_samples(
    samples: DataFrame,
    windows: DataFrame,
    width_seconds: float,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    salts: int = SALTS,
) -> DataFrame:
    """the samples of each reading window, both ends inclusive.

    Example columns come back with ``example_ts`` in place of the sample's own time column.
    """
    examples = windows.withColumnRenamed(ts, "example_ts")
    return interval_join(samples, examples, keys, ts, "window_start", "window_end", width_seconds, salts=salts)


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("machine_id", "ts")) -> DataFrame:
    """Wide frame as (keys, series, value) rows, missing values left out."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("series"), col(c).cast("double").alias("value")) for c in columns
    ]))
    return df.select(*pick(keys), cells.alias("__c")).select(*pick(keys), "__c.*").filter("value is not null")


def samples_used(
    samples: DataFrame, windows: DataFrame, width_seconds: float,
    keys: Sequence[str] = ("machine_id",), ts: str = "ts", drop_empty: bool = True,
) -> DataFrame:
    """F13 + F14: per example the number of timeline rows in its window.

    Empty windows fall out, or stay with 0 so that they count as processed.
    """
    times = samples.select(*pick(keys), col(ts)).distinct()
    examples = windows.withColumnRenamed(ts, "example_ts")
    pairs = interval_join(times, examples, keys, ts, "window_start", "window_end", width_seconds,
                          how="inner" if drop_empty else "left")
    meta = [c for c in examples.columns]
    return pairs.groupBy(*pick(meta)).agg(F.count(col(ts)).alias("samples_used"))


def storable(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with any missing feature are not stored."""
    return features.na.drop("any", subset=[f"`{c}`" for c in columns])

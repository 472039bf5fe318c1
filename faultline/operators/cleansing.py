"""Column and row filters driven by the data."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.names import col, is_error_code, numeric_columns, pick
from faultline.operators import gram

UNAVAILABLE = "UNAVAILABLE"

# The machine modes that may be selected and the columns that show them.
MACHINE_MODES = {
    "door_state": ("ALL", "UNAVAILABLE", "CLOSED", "UNLATCHED"),
    "door_functioning_mode": ("ALL", "UNAVAILABLE", "PRODUCTION", "SETUP"),
    "spindle_mode": ("ALL", "UNAVAILABLE", "CONTOUR", "SPINDLE"),
    "path_mode": ("ALL", "AUTOMATIC", "MANUAL_DATA_INPUT", "UNAVAILABLE", "MANUAL"),
    "path_execution_state": (
        "ALL", "UNAVAILABLE", "READY", "STOPPED", "ACTIVE", "INTERRUPTED",
        "PROGRAM_STOPPED", "OPTIONAL_STOP", "FEED_HOLD",
    ),
}
MODE_COLUMNS = {
    "door_state": ("components.door1.events.door.state",),
    "door_functioning_mode": ("components.d1.events.functionalmode.state",),
    "spindle_mode": (
        "components.c.events.rf.state", "components.c2.events.rf2.state",
        "components.c3.events.rf3.state", "components.c4.events.rf4.state",
    ),
    "path_mode": ("components.path1.events.mode.state", "components.path2.events.mode2.state"),
    "path_execution_state": ("components.path1.events.exec.state", "components.path2.events.exec2.state"),
}


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide columns as (keys, column, value) text rows, nulls left out."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), col(c).cast("string").alias(value)) for c in columns
    ]))
    return df.select(*pick(keys), cells.alias("__cell")).select(*pick(keys), "__cell.*").filter(col(value).isNotNull())


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct non-null values per column, long."""
    return to_long(df, columns, []).distinct()


def constant_profile(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str | None, str | None, bool]]:
    """Per column (smallest value, largest value, anything in between), from two plain aggregates.

    Tells 0, 1, 2 and more distinct values apart without shuffling a value: the second pass
    only looks for something strictly between the extremes of the first. One row comes back.
    """
    ends = df.agg(*[e for i, c in enumerate(columns) for e in
                    (F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"))]).first()
    open_cols = [i for i in range(len(columns)) if ends[f"lo{i}"] is not None and ends[f"lo{i}"] != ends[f"hi{i}"]]
    inside = {}
    if open_cols:
        row = df.agg(*[
            F.max((col(columns[i]) != F.lit(ends[f"lo{i}"])) & (col(columns[i]) != F.lit(ends[f"hi{i}"]))).alias(f"m{i}")
            for i in open_cols
        ]).first()
        inside = {i: bool(row[f"m{i}"]) for i in open_cols}
    return {c: (ends[f"lo{i}"], ends[f"hi{i}"], inside.get(i, False)) for i, c in enumerate(columns)}


def constant_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    only_null_or_empty: bool = True,
    only_one: bool = True,
    only_one_and_unavailable: bool = True,
) -> list[str]:
    """Names of columns with no value, one value, or one value besides 'unavailable'."""
    columns = list(columns) if columns is not None else df.columns

    def constant(low, high, between) -> bool:
        if low is None:
            return only_null_or_empty
        if low == high:
            return only_one
        shouted = {str(v).upper() for v in (low, high)}
        return only_one_and_unavailable and not between and UNAVAILABLE in shouted

    return [c for c, seen in constant_profile(df, columns).items() if constant(*seen)]


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = (), **switches: bool) -> DataFrame:
    """C3 applied."""
    candidates = [c for c in df.columns if c not in keep]
    return df.drop(*constant_columns(df, candidates, **switches))


def drop_error_codes(df: DataFrame, target: str, skip: bool = True) -> DataFrame:
    """Drop the error-code columns except the target."""
    if skip:
        return df
    return df.drop(*[c for c in df.columns if is_error_code(c) and c != target])


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair of numeric columns over the rows where both are present, in one pass.

    None where a column is constant in those rows, or holds a value that isn't a finite number.
    """
    if columns is None:
        columns = [c for c in numeric_columns(df) if not is_error_code(c)]
    if len(columns) < 2:
        return {}
    found = gram.pearson_of_pairs(df, columns)
    return {(columns[i], columns[j]): None if np.isnan(found[i, j]) else float(found[i, j]) for i, j in itertools.combinations(range(len(columns)), 2)}


def correlated_columns(
    df: DataFrame, threshold: float = 1.0, columns: Sequence[str] | None = None
) -> list[str]:
    """Columns whose absolute correlation with any earlier column reaches the threshold.

    Coefficients are rounded to 12 places, so that an exact copy reaches 1 whatever the
    order of summation was.
    """
    reached = {b for (_, b), r in correlations(df, columns).items()
               if r is not None and r == r and round(abs(r), 12) >= threshold}
    return [c for c in df.columns if c in reached]


def drop_correlated(df: DataFrame, threshold: float = 1.0, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*correlated_columns(df, threshold, columns))


def check_modes(
    selected: Mapping[str, Sequence[str]],
    modes: Mapping[str, Sequence[str]] = MACHINE_MODES,
    columns: Mapping[str, Sequence[str]] = MODE_COLUMNS,
) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """C17: validated selection as key -> (columns, values), without keys that allow everything."""
    filters = {}
    for key, values in selected.items():
        if "ALL" in values and len(values) > 1:
            raise ValueError('"ALL" cannot be combined with other machine modes')
        unknown = [v for v in values if v not in modes[key]]
        if unknown:
            raise ValueError(f"machine modes {unknown} do not exist for {key!r}")
        if "ALL" not in values:
            filters[key] = tuple(columns[key]), tuple(values)
    return filters


def mode_predicate(df: DataFrame, filters: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> Column | None:
    """OR over the columns and values of a mode, AND between modes; absent columns are passed over."""
    per_mode = []
    for columns, values in filters.values():
        here = [col(c).isin(list(values)) for c in columns if c in df.columns]
        if here:
            per_mode.append(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in here]))
    return reduce(lambda a, b: a & b, per_mode) if per_mode else None


def filter_modes(
    df: DataFrame,
    selected: Mapping[str, Sequence[str]],
    modes: Mapping[str, Sequence[str]] = MACHINE_MODES,
    columns: Mapping[str, Sequence[str]] = MODE_COLUMNS,
) -> DataFrame:
    """C17 applied."""
    predicate = mode_predicate(df, check_modes(selected, modes, columns))
    return df if predicate is None else df.filter(predicate)


def drop_outliers(
    df: DataFrame, number_stds: float = 3, how: str = "all", columns: Sequence[str] | None = None
) -> DataFrame:
    """Drop rows outside mean +/- k sample standard deviations in all (or any) columns.

    The bounds come back as one row and enter the filter as literals, which reach the scan.
    """
    if how not in ("all", "any"):
        raise ValueError("how must be 'all' or 'any'")
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return df
    stats = df.agg(*[e for i, c in enumerate(columns) for e in
                     (F.avg(col(c)).alias(f"m{i}"), F.stddev_samp(col(c)).alias(f"s{i}"))]).first()

    def outside(i: int, c: str) -> Column:
        mean, std = stats[f"m{i}"], stats[f"s{i}"]
        if mean is None or std is None or std != std:
            return F.lit(False)
        low, high = mean - number_stds * std, mean + number_stds * std
        return F.coalesce((col(c) < F.lit(low)) | (col(c) > F.lit(high)), F.lit(False))

    flags = [outside(i, c) for i, c in enumerate(columns)]
    join = (lambda a, b: a & b) if how == "all" else (lambda a, b: a | b)
    return df.filter(~reduce(join, flags))

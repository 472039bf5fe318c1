"""Missing values: markers, forward fill, interpolation, valid ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from faultline.functions.names import col, columns_of, pick, roles
from faultline.functions.times import epoch_us
from faultline.operators.ordered import SLOT_SECONDS, scan
from faultline.params import EXTREME_MARKER
from faultline.session import settle

TEXT_METHODS = ("pad",)
NUMERIC_METHODS = ("pad", "linear", "time")


def missing_to_null(field: T.StructField) -> Column:
    """'' and NaN both mean "missing"."""
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(field.name)), col(field.name)).alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.nullif(col(field.name), F.lit("")).alias(field.name)
    return col(field.name)


def normalise_missing(df: DataFrame, keys: Sequence[str] = ("machine_id", "ts")) -> DataFrame:
    """Missing markers become null; rows without any value besides their key are dropped."""
    values = [f.name for f in df.schema.fields if f.name not in keys]
    return df.select(*[missing_to_null(f) for f in df.schema.fields]).na.drop("all", subset=[f"`{v}`" for v in values])


def replace_extreme(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The extreme marker becomes null."""
    return df.withColumns({c: F.nullif(col(c), F.lit(EXTREME_MARKER)) for c in columns})


def _fill(
    df: DataFrame, pad: Sequence[str], line: Sequence[str], method: str, keys: Sequence[str], ts: str,
    tie: Sequence[str], limit: int | None, slot_seconds: float,
) -> DataFrame:
    """Pad some columns and interpolate others with one scan over the rows."""
    if not pad and not line:
        return df
    numbered = limit is not None or (bool(line) and method == "linear")
    place = F.col("__pos") if numbered else F.lit(0)
    at = (F.col("__pos") if method == "linear" else epoch_us(col(ts))).cast("double")

    def known(c: str) -> Column:
        if c in pad and not numbered:
            return col(c)
        value = col(c).cast("double") if c in line else col(c)
        x = [at.alias("x")] if c in line else []
        return F.when(col(c).isNotNull(), F.struct(place.alias("p"), *x, value.alias("v")))

    columns = [*pad, *line]
    looked = scan(
        df, keys, ts, tie,
        last={f"__a{i}": known(c) for i, c in enumerate(columns)},
        next={f"__b{i}": known(c) for i, c in enumerate(columns) if c in line},
        position="__pos" if numbered else None, slot_seconds=slot_seconds,
    )

    def filled(i: int, c: str) -> Column:
        a = F.col(f"__a{i}")
        if c in pad and not numbered:
            return a
        value = a["v"]
        if c in line:
            b = F.col(f"__b{i}")
            inner = a["v"] + (b["v"] - a["v"]) * (at - a["x"]) / (b["x"] - a["x"])
            value = F.when(col(c).isNotNull() | b.isNull(), a["v"]).when(a.isNotNull(), inner)
        return value if limit is None else F.when(F.col("__pos") - a["p"] <= limit, value)

    done = {c: filled(i, c) for i, c in enumerate(columns)}
    return looked.select(*[done[c].alias(c) if c in done else col(c) for c in df.columns])


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    limit: int | None = None,
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """Last known value; with ``limit``, at most that many rows after it."""
    return _fill(df, columns, (), "pad", keys, ts, tie, limit, slot_seconds)


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    method: str,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    limit: int | None = None,
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """C8 ``linear`` (by row number) and C9 ``time`` (by elapsed time).

    Leading gaps stay null, trailing gaps take the last value, ``limit`` bounds the
    number of rows filled after a value.
    """
    if method not in ("linear", "time"):
        raise ValueError(f"{method!r} is not an interpolation method")
    return _fill(df, (), columns, method, keys, ts, tie, limit, slot_seconds)


def check_methods(string_method: str, numeric_method: str) -> None:
    if string_method not in TEXT_METHODS:
        raise ValueError(f"{string_method!r} is not a valid imputation method for string columns")
    if numeric_method not in NUMERIC_METHODS:
        raise ValueError(f"{numeric_method!r} is not a valid imputation method for numeric columns")


def impute(
    df: DataFrame,
    string_method: str = "pad",
    numeric_method: str = "pad",
    extreme_to_null: bool = True,
    limit: int | None = None,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """C7-C9 routed by column role (C11): sample values by ``numeric_method``, the rest is padded."""
    check_methods(string_method, numeric_method)
    numeric = columns_of(df, "numeric", exclude=[*keys, ts])
    padded = columns_of(df, "text", "code", exclude=[*keys, ts])
    if extreme_to_null:
        doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in keys]
        df = replace_extreme(df, doubles)
    pad, line = ([*numeric, *padded], []) if numeric_method == "pad" else (padded, numeric)
    return _fill(df, pad, line, numeric_method, keys, ts, (), limit, slot_seconds)


def valid_ranges(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("machine_id",), ts: str = "ts"
) -> DataFrame:
    """Per column, first and last time with a value (long: keys, column, first_ts, last_ts)."""
    present = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(F.when(col(c).isNotNull(), col(ts))).alias("first_ts"),
            F.max(F.when(col(c).isNotNull(), col(ts))).alias("last_ts"),
        )
        for c in columns
    ]
    wide = df.groupBy(*pick(keys)).agg(*[p.alias(f"__r{i}") for i, p in enumerate(present)])
    ranges = F.explode(F.array(*[F.col(f"__r{i}") for i in range(len(columns))]))
    return wide.select(*pick(keys), ranges.alias("r")).select(*pick(keys), "r.*")


def slice_valid(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    extrapolate: bool = True,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    max_late_start: float | None = None,
) -> DataFrame:
    """Keep the stretch in which every column has started (and, optionally, not ended).

    A column that never holds a value does not count. ``max_late_start`` (seconds) drops
    columns that start later than this after the first row before the bounds are taken, so
    that one late sensor cannot discard years of data; the coverage report is
    :func:`valid_ranges`.
    """
    columns = list(columns) if columns is not None else list(roles(df, exclude=[*keys, ts]))
    if max_late_start is not None:
        late = _late_columns(df, columns, ts, max_late_start)
        df, columns = df.drop(*late), [c for c in columns if c not in late]
    if not columns:
        return df
    bounds = valid_ranges(df, columns, keys, ts).groupBy(*pick(keys)).agg(
        F.max("first_ts").alias("__from"), F.min("last_ts").alias("__to")
    )
    inside = col(ts) >= F.col("__from")
    if not extrapolate:
        inside = inside & (col(ts) <= F.col("__to"))
    # a row per machine, written first: its known size lets Spark send it to the rows instead of gathering a machine
    return df.join(settle(bounds, "bounds"), list(keys)).filter(inside).select(*pick(df.columns))


def _late_columns(df: DataFrame, columns: Sequence[str], ts: str, seconds: float) -> list[str]:
    """Names of columns whose first value comes too late; the result has one row per run, not per record."""
    row = df.agg(
        F.min(epoch_us(col(ts))).alias("__start"),
        *[F.min(F.when(col(c).isNotNull(), epoch_us(col(ts)))).alias(f"__f{i}") for i, c in enumerate(columns)],
    ).first()
    return [c for i, c in enumerate(columns)
            if row[f"__f{i}"] is not None and row[f"__f{i}"] - row["__start"] > seconds * 1_000_000]


def trim_start(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("machine_id",), ts: str = "ts") -> DataFrame:
    """Drop the rows before the first value of any column."""
    any_value = reduce(lambda a, b: a | b, [col(c).isNotNull() for c in columns])
    start = df.filter(any_value).groupBy(*pick(keys)).agg(F.min(col(ts)).alias("__from"))
    return df.join(settle(start, "starts"), list(keys)).filter(col(ts) >= F.col("__from")).select(*pick(df.columns))

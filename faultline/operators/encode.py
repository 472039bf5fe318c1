"""Categories as indicator columns, rows or vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, functions as F

from faultline.functions.names import col, columns_of, is_error_code, pick
from faultline.operators.cleansing import to_long
from faultline.operators.timeline import objects_to_text


def category_columns(df: DataFrame, target: str | None, exclude: Sequence[str] = ()) -> list[str]:
    """Text columns and every error-code column but the target."""
    skip = {*exclude, *([target] if target else [])}
    return [c for c in columns_of(df, "text", "code", exclude=skip)]


def one_hot_long(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("machine_id", "ts"), string_nulls: str = "keep"
) -> DataFrame:
    """C14, sparse form: a row (keys, series = '<column>.<value>', 1) per category present.

    Needs neither the list of levels nor a shuffle; the form to use for thousands of levels.
    """
    text = objects_to_text(df, exclude=keys, string_nulls=string_nulls)
    long = to_long(text, columns, keys)
    return long.select(*pick(keys), F.concat_ws(".", "column", "value").alias("series"), F.lit(1).alias("value"))


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct values per column: one entry per resulting column of the wide form, whose plan has to name them all.

    For many levels use ``one_hot_long`` and ``level_names``, which stay tables.
    """
    found = to_long(df, columns, []).distinct()
    by_column: dict[str, list[str]] = {c: [] for c in columns}
    for row in found.orderBy("column", "value").collect():
        by_column[row["column"]].append(row["value"])
    return by_column


def level_names(long: DataFrame, series: str = "series") -> DataFrame:
    """The categories of the sparse form, a row each."""
    return long.select(series).distinct()


def one_hot(
    df: DataFrame, target: str | None, keys: Sequence[str] = ("machine_id", "ts"), string_nulls: str = "keep"
) -> DataFrame:
    """C14, wide form: one 0/1 column '<column>.<value>' per level, no level left out, in one select."""
    columns = category_columns(df, target, keys)
    if not columns:
        return df
    text = objects_to_text(df, exclude=keys, string_nulls=string_nulls)
    shown = [
        (col(c).cast("string").eqNullSafe(F.lit(v))).cast("int").alias(f"{c}.{v}")
        for c, values in levels(text, columns).items() for v in values
    ]
    return text.select(*pick(c for c in df.columns if c not in columns), *shown)


def one_hot_vectors(df: DataFrame, columns: Sequence[str], suffix: str = "_vec") -> DataFrame:
    """C14, vector form: one sparse vector per category column for Spark ML."""
    safe = {c: c.replace(".", "_") for c in columns}
    renamed = df.select(*[col(c).alias(safe.get(c, c)) for c in df.columns])
    index = StringIndexer(inputCols=list(safe.values()), outputCols=[f"{s}_idx" for s in safe.values()],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{s}{suffix}" for s in safe.values()],
                           dropLast=True)  # the last slot is the one handleInvalid adds for nulls
    return Pipeline(stages=[index, encode]).fit(renamed).transform(renamed).drop(*index.getOutputCols())


def error_occurrence(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ("machine_id", "ts")) -> DataFrame:
    """0/1 column '<column>_<code>_occured' per error code, replacing the code columns."""
    columns = list(columns) if columns is not None else [c for c in df.columns if is_error_code(c)]
    as_int = df.withColumns({c: col(c).cast("bigint") for c in columns})
    shown = [
        F.coalesce((col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}_occured")
        for c, values in levels(as_int, columns).items() for v in values
    ]
    return as_int.select(*pick(c for c in df.columns if c not in columns), *shown)

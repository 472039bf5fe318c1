"""Column names and the roles they imply."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its literal name; wide log columns contain dots."""
    return F.col(quoted(name))


def pick(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def is_error_code(name: str) -> bool:
    return "errorCode" in name


def is_sample_value(name: str) -> bool:
    return ".samples." in name and ".value" in name


def role(name: str, dtype: T.DataType) -> str:
    """C11: every column gets exactly one role: time, code, numeric or text."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if is_error_code(name):
        return "code"
    if is_sample_value(name) or isinstance(dtype, T.NumericType):
        return "numeric"
    return "text"


def roles(df: DataFrame, exclude: Iterable[str] = ()) -> dict[str, str]:
    skip = set(exclude)
    return {f.name: role(f.name, f.dataType) for f in df.schema.fields if f.name not in skip}


def columns_of(df: DataFrame, *wanted: str, exclude: Iterable[str] = ()) -> list[str]:
    return [n for n, r in roles(df, exclude).items() if r in wanted]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]

"""One timeline per machine from many asynchronous series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from faultline.functions.names import col, pick

# Machine ids accepted by the single-machine filter.
MACHINE_IDS = ("MAZAK-M7303290458", "Integrex", "VTC530C")

# Substrings of column names per switchable group.
NAME_GROUPS = {
    "device": ("_id.$oid", "className", "machine", "machineId"),
    "name": (".name",),
    "type": (".componentType", ".eventType", ".type", ".subType"),
    "timestamp": ("timestamp.$date",),
    "sequence_number": (".sequence.$numberLong",),
    "state": (".status", ".state"),
    "message": (".message",),
}
DEFAULT_GROUPS = ("device", "name", "type")


def single_machine(
    df: DataFrame, machine_id: str = MACHINE_IDS[0], column: str = "machineId", valid: Sequence[str] = MACHINE_IDS
) -> DataFrame:
    """Rows of one machine; an id outside ``valid`` is an error, no rows is an empty frame."""
    if machine_id not in valid:
        raise ValueError(f"machine_id {machine_id!r} is not a valid id, choose from {list(valid)}")
    return df.filter(col(column) == F.lit(machine_id))


def patterns_of(groups: Sequence[str]) -> list[str]:
    return [p for g in groups for p in NAME_GROUPS[g]]


def drop_named(df: DataFrame, groups: Sequence[str] = DEFAULT_GROUPS, keep: Sequence[str] = ()) -> DataFrame:
    """Drop every column whose name contains a pattern of the groups."""
    patterns = patterns_of(groups)
    return df.select(*pick(c for c in df.columns if c in keep or not any(p in c for p in patterns)))


def drop_named_fields(long: DataFrame, groups: Sequence[str] = DEFAULT_GROUPS, field: str = "field") -> DataFrame:
    """R5 on long rows, where the name is a value."""
    kept = F.lit(True)
    for pattern in patterns_of(groups):
        kept = kept & ~F.contains(col(field), F.lit(pattern))
    return long.filter(kept)


def stack_repeats(frames: Sequence[DataFrame], values: Sequence[str]) -> DataFrame:
    """The repeated parts of one series under each other, without rows that hold no value."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.na.drop("all", subset=[f"`{v}`" for v in values])


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], newest: bool) -> DataFrame:
    """One row per key: the newest or oldest by ``order``.

    An aggregate, not a window: copies of a key are reduced before the shuffle, so a key
    that holds a large share of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if newest else F.min_by
    best = df.groupBy(*pick(keys)).agg(choose(F.struct(*pick(rest)), F.struct(*order)).alias("__best"))
    return best.select(*[col(c) if c in keys else F.col("__best")[c].alias(c) for c in df.columns])


def latest_wins(
    samples: DataFrame,
    keys: Sequence[str] = ("machine_id", "series", "ts"),
    sequence: str = "seq",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Per series and timestamp the record with the highest sequence number, then the later row."""
    return keep_one(samples, keys, [col(sequence).cast("double"), *pick(tie)], newest=True)


def first_per_timestamp(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("machine_id", "ts")) -> DataFrame:
    """Per timestamp the first row in ``order`` (for example file name and row index)."""
    return keep_one(df, keys, pick(order), newest=False)


def timeline(samples: DataFrame, keys: Sequence[str] = ("machine_id",), ts: str = "ts") -> DataFrame:
    """Every timestamp at which some series has a record."""
    return samples.select(*pick(keys), col(ts)).distinct()


def series_names(samples: DataFrame, series: str = "series") -> list[str]:
    """Distinct series: as many values as the wide frame has columns."""
    return sorted(r[0] for r in samples.select(col(series)).distinct().collect() if r[0] is not None)


def widen(
    samples: DataFrame,
    value: str,
    names: Sequence[str] | None = None,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    series: str = "series",
) -> DataFrame:
    """All series next to each other on the timeline, by one pivot instead of one join per series.

    Input must hold one record per (keys, ts, series), as :func:`latest_wins` gives. Local
    time and sequence columns do not survive (R10).
    """
    names = list(names) if names is not None else series_names(samples, series)
    return samples.groupBy(*pick(keys), col(ts)).pivot(series, names).agg(F.max(col(value)))


def attach_series(line: DataFrame, series: DataFrame, keys: Sequence[str], local: Sequence[str]) -> DataFrame:
    """R9 for a few wide series: left join on the timeline, dropping local columns.

    Raises when the series lacks one of the local columns it must bring along.
    """
    absent = [c for c in local if c not in series.columns]
    if absent:
        raise ValueError(f"local time or sequence columns are missing: {absent}")
    return line.join(series.drop(*local), list(keys), "left")


def objects_to_text(df: DataFrame, exclude: Sequence[str] = (), string_nulls: str = "keep") -> DataFrame:
    """Non-numeric, non-time columns as text; ``literal`` writes nulls as the text 'nan'."""
    if string_nulls not in ("keep", "literal"):
        raise ValueError("string_nulls must be 'keep' or 'literal'")
    plain = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)

    def text(field: T.StructField) -> Column:
        if field.name in exclude or isinstance(field.dataType, plain):
            return col(field.name)
        value = col(field.name).cast("string")
        if string_nulls == "literal":
            value = F.coalesce(value, F.lit("nan"))
        return value.alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])

"""Site logs in CSV or Parquet form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from faultline.functions.names import col

# Column names of the site logs.
RENAMES = {"time": "global_timestamp", "timestamp": "global_timestamp", "errorcode": "errorCode"}
DROPPED = ("main_id", "Unnamed: 0")


def _parsed(df: DataFrame) -> DataFrame:
    renamed = df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})
    return renamed.withColumn("global_timestamp", col("global_timestamp").cast("timestamp_ntz"))


def clean_site_log(df: DataFrame) -> DataFrame:
    """Names unified, time parsed, bookkeeping columns and duplicate rows dropped, everything but
    samples and time as text, the error code as integer."""
    tidy = _parsed(df).drop(*DROPPED).dropDuplicates()
    samples = [c for c in tidy.columns if "samples" in c or "global_timestamp" in c]
    text = tidy.select(*[col(c) if c in samples else col(c).cast("string").alias(c) for c in tidy.columns])
    return text.withColumn("errorCode", col("errorCode").cast("double").cast("int")) if "errorCode" in text.columns else text


def pivot_sensors(
    df: DataFrame, sensor: str = "sensor", value: str = "gesamtwirkleistung", names: Sequence[str] | None = None,
    duplicates: str = "raise",
) -> DataFrame:
    """S5 + S6 for sensor logs: one column '<sensor>.samples' per sensor; (time, sensor) must be unique, unless
    ``duplicates="max"``, which keeps the largest value of repeated entries."""
    if duplicates not in ("raise", "max"):
        raise ValueError('duplicates must be "raise" or "max"')
    parsed = _parsed(df).drop(*DROPPED).withColumn("__name", F.concat(col(sensor).cast("string"), F.lit(".samples")))
    if names is None:
        names = sorted(r[0] for r in parsed.select("__name").distinct().collect())
    if duplicates == "raise":
        twice = parsed.groupBy("global_timestamp", "__name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not twice.isEmpty():
            raise ValueError("sensor log holds duplicate (time, sensor) entries")
    return parsed.groupBy("global_timestamp").pivot("__name", list(names)).agg(F.max(col(value)))


def unify_site_log(df: DataFrame, is_sensor_log: bool) -> DataFrame:
    """S5 as a whole, routed by the kind of log."""
    return pivot_sensors(df) if is_sensor_log else clean_site_log(df)



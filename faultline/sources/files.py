"""File selection and multi-file tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.functions.keys import draw_key
from faultline.functions.names import col, pick


def stem(path: Column) -> Column:
    """File name without directories and without its last two suffixes (a.b.json.gz -> a.b)."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    once = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(once, r"(?<=.)\.[^.]*$", "")


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths that match, one row each, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(glob).select("path")


def unprocessed(raw: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Raw files whose stem has no processed counterpart."""
    seen = done.select(stem(col(path)).alias("__stem")).distinct()
    return raw.withColumn("__stem", stem(col(path))).join(seen, "__stem", "left_anti").select(*pick(raw.columns))


def sample_files(files: DataFrame, n: int, seed: int, path: str = "path") -> DataFrame:
    """N files drawn at random, repeatably; a file list is bounded by the number of files."""
    return files.orderBy(draw_key(seed, col(path)), col(path)).limit(n)


def common_columns(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Column names present in every file, sorted. Only footers are read, several at a time."""
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(lambda p: set(spark.read.parquet(p).columns), paths))
    return sorted(set.intersection(*schemas)) if schemas else []


def read_common(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files as one frame with the columns they share; column pruning reaches the scan."""
    return spark.read.parquet(*paths).select(*pick(common_columns(spark, paths)))


def write_buffer(df: DataFrame, path: str, source_file: str = "source_file") -> None:
    """One directory per source file."""
    df.write.mode("append").partitionBy(source_file).parquet(path)

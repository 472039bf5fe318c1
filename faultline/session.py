"""Session set-up and lineage cuts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_settled: list[list[tuple[SparkSession, str]]] = []


def build_session(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Cluster deployments normally bring their own session; nothing below is required
    for right results except UTC when LTZ timestamps are used (the operators stay on NTZ).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a fresh local folder serves a local master, where driver and executors share one machine;
    on any other master it is an error, because tables written there would be incomplete.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors of {master or 'the cluster'} share")
        configured = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    return configured.rstrip("/")


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block, shuffle files go as soon as the query that wrote them has ended."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def settle(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage and plan size before a result is used several times. The table outlives
    lost executors, is computed once, and later reads still prune columns. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    for paths in _settled:
        paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settled_tables(keep_last: bool = False) -> Iterator[None]:
    """Within the block, ``settle`` keeps account of its tables; at the end they are removed.

    For jobs whose result no longer depends on them (it was written, or collected, inside the block). With ``keep_last`` the
    last table, which is the result, stays if the block ends well; a block around this one removes it.
    """
    paths: list[tuple[SparkSession, str]] = []
    _settled.append(paths)
    kept = 0
    try:
        yield
        kept = int(keep_last)
    finally:
        _settled[:] = [held for held in _settled if held is not paths]
        for spark, path in paths[: len(paths) - kept]:
            remove_table(spark, path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``settle`` has written, through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

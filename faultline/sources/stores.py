"""Stored stages, examples and results."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions.names import pick
from faultline.params import Horizon


class StageStore:
    """Results of expensive stages, kept as Parquet under a key of everything they depend on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(stage: str, parents: Sequence[str], **parameters: Any) -> str:
        """Digest of the stage's name, its parents' keys and all parameters, input list included."""
        plain = json.dumps({"stage": stage, "parents": list(parents), "parameters": parameters},
                           sort_keys=True, default=lambda o: dataclasses.asdict(o) if dataclasses.is_dataclass(o) else str(o))
        return hashlib.sha256(plain.encode()).hexdigest()[:32]

    def _path(self, stage: str, key: str) -> str:
        return f"{self.root}/stage={stage}/key={key}"

    def _complete(self, path: str) -> bool:
        jvm = self.spark._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def create_or_load(self, stage: str, build: Callable[[], DataFrame], parents: Sequence[str] = (), **parameters: Any) -> tuple[DataFrame, str]:
        """(result, key). A stage that was written only in part is written again."""
        key = self.key(stage, parents, **parameters)
        path = self._path(stage, key)
        if not self._complete(path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), key


EXAMPLE_PARTITIONS = ("errorcode", "pw", "rw", "cls")


def append_examples(examples: DataFrame, path: str, errorcode: int, horizon: Horizon, positive: bool) -> None:
    """Add examples to the store, one partition per (errorcode, PW, RW, pos/neg)."""
    tagged = examples.withColumns({
        "errorcode": F.lit(errorcode), "pw": F.lit(horizon.pw), "rw": F.lit(horizon.rw),
        "cls": F.lit("pos" if positive else "neg"),
    })
    tagged.write.mode("append").partitionBy(*EXAMPLE_PARTITIONS).parquet(path)


def stored_examples(spark: SparkSession, path: str, errorcode: int, horizon: Horizon, positive: bool) -> DataFrame | None:
    """Stored examples of one combination; only its partition is read. None without a store."""
    try:
        store = spark.read.parquet(path)
    except AnalysisException:
        return None
    return of_partition(store, errorcode, horizon, positive)


def of_partition(store: DataFrame, errorcode: int, horizon: Horizon, positive: bool) -> DataFrame:
    wanted = (
        (F.col("errorcode") == errorcode) & (F.col("pw") == horizon.pw) & (F.col("rw") == horizon.rw)
        & (F.col("cls") == ("pos" if positive else "neg"))
    )
    return store.filter(wanted).drop(*EXAMPLE_PARTITIONS)


def processed_timestamps(store: DataFrame, keys: Sequence[str] = ("machine_id", "ts")) -> DataFrame:
    """Keys of the stored examples."""
    return store.select(*pick(keys)).distinct()


def append_results(summary: DataFrame, path: str, **run: Any) -> None:
    """One evaluation row per run and seed, with the run's parameters."""
    tagged = summary.withColumns({k: F.lit(v if isinstance(v, (int, float, str, bool)) else str(v)) for k, v in run.items()})
    tagged.withColumn("written_at", F.current_timestamp()).write.mode("append").option("mergeSchema", "true").parquet(path)


def write_mining(path: str, params: Any, frequent: DataFrame, rules: DataFrame) -> None:
    """Configuration, itemsets and rules as three tables."""
    spark = frequent.sparkSession
    spark.createDataFrame([dataclasses.asdict(params)]).write.mode("overwrite").parquet(f"{path}/config")
    frequent.write.mode("overwrite").parquet(f"{path}/fq_itemsets")
    rules.write.mode("overwrite").parquet(f"{path}/asc_rules")

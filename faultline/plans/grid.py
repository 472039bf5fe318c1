"""A grid of runs that goes on where it stopped.

Runs are a table keyed by all of their parameters; those whose key stands in the stored results are done. What several runs
share is built once for each prefix of parameters and kept in a stage store: the cleansed frame for those of the cleansing, the
example matrix for those of windows and features as well. A stage that was written only in part is written again; a run's
results are appended when it is complete. So a grid may be stopped anywhere, extended, and started again.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.operators import labels
from faultline.operators.sampling import class_counts
from faultline.params import PredictionParams, parameter_grid
from faultline.plans import prediction
from faultline.session import settle, settled_tables
from faultline.sources import stores

#: Parameters that the stages depend on, each stage on those of the one before too.
CLEANSING = ("target_col", "sampling_seconds", "string_fill", "numeric_fill", "replace_extreme")
EXAMPLES = ("target_code", "horizon", "minimal_features", "scaler", "fit_scaler_per_fold", "balance_ratio", "seeds")


def run_key(run: Any, source: str = "") -> str:
    """Digest of all parameters of a run and of what it runs on."""
    return stores.StageStore.key("run", [source], kind=type(run).__name__, run=dataclasses.asdict(run))


def _flat(run: Any) -> dict[str, Any]:
    """Parameters as plain columns; the horizon as its two lengths, lists as text."""
    plain: dict[str, Any] = {}
    for name, value in dataclasses.asdict(run).items():
        if name == "horizon":
            plain |= {"pw": value["pw"], "rw": value["rw"]}
        else:
            plain[name] = value if isinstance(value, (int, float, str, bool)) else str(value)
    return plain


def runs_table(spark: SparkSession, runs: Iterable[Any], source: str = "") -> DataFrame:
    """``run`` (the key), ``position`` and the parameters of every run; equal runs once."""
    rows, seen = [], set()
    for run in runs:
        key = run_key(run, source)
        if key not in seen:
            rows.append({"run": key, "position": len(rows), **_flat(run)})
            seen.add(key)
    if not rows:
        raise ValueError("a grid needs at least one run")
    return spark.createDataFrame(rows)


def stored_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All results so far; None before the first."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return None


def pending(runs: DataFrame, results: DataFrame | None) -> DataFrame:
    """The runs without results."""
    return runs if results is None else runs.join(results.select("run").distinct(), "run", "left_anti")


def _some(p: PredictionParams, names: Sequence[str]) -> dict[str, Any]:
    return {n: getattr(p, n) for n in names}


def run_grid(frame: DataFrame, options: Mapping[str, Sequence[Any]], root: str, source: str) -> DataFrame:
    """Every combination of ``options`` on a global frame; all results under ``root``, old and new.

    ``source`` names what the frame holds (a path, a date): stages and results of another source are not taken over. Runs that
    add to an example store aren't for a grid, as they depend on each other; use ``prediction.run`` for them.
    """
    runs = {run_key(p, source): p for p in parameter_grid(options)}
    if any(p.store_examples for p in runs.values()):
        raise ValueError("runs that store examples depend on each other")
    spark, store, path = frame.sparkSession, stores.StageStore(frame.sparkSession, f"{root.rstrip('/')}/stages"), f"{root.rstrip('/')}/results"
    table = runs_table(spark, runs.values(), source)
    for row in pending(table, stored_results(spark, path)).orderBy("position").collect():  # a row a run
        p = runs[row["run"]]
        with settled_tables():
            def cleansed() -> DataFrame:
                return prediction.cleanse(frame, p)  # noqa: B023

            given, key = store.create_or_load("cleansed", cleansed, [source], **_some(p, CLEANSING))

            def examples() -> DataFrame:
                codes = settle(labels.code_series(frame, p.target_col).filter(F.col("code").isNotNull()), "codes")  # noqa: B023
                drawn = prediction.examples_for(codes, p)  # noqa: B023
                long = prediction.example_features(prediction.window_input(given, p), drawn, p.horizon, p.minimal_features)  # noqa: B023
                return prediction.matrix(long, p)  # noqa: B023

            rows, _ = store.create_or_load("examples", examples, [key], **_some(p, EXAMPLES))
            if len(counts := class_counts(rows)) < 2:
                raise ValueError(f"both classes are needed, got {counts}")
            stores.append_results(prediction.evaluated(rows, p), path, run=row["run"], **_flat(p))
    return stored_results(spark, path).join(table.select("run"), "run", "left_semi")

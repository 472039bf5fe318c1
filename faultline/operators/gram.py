"""Sums over all pairs of columns in one pass.

Every task multiplies its rows' matrix with itself, values less a common centre, and with the matrix of what is present, so that
a pair of columns is summed over the rows where both are present. Tasks emit their sums as blocks of ``SIDE`` by ``SIDE`` pairs;
blocks are added up in two steps, so no task receives more than a share of them and none holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.functions.names import col
from faultline.session import settle

SIDE = 64
#: Tasks of the first step for each block.
SLOTS = 64
#: Rows that give the centre; any centre gives the same moments, a near one keeps more digits.
CENTRE_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SUMS = "row int, column int, slot int, sums binary"


def _products(x: np.ndarray) -> Iterator[np.ndarray]:
    """Number, sum of the row's column, sum of its squares, sum of products, and number of rows with a value that isn't a number."""
    present, odd = ~np.isnan(x[0]), x[1]
    held, mask = np.where(present, x[0], 0.0), (present | (odd > 0)).astype(float)
    yield mask.T @ mask
    yield held.T @ mask
    yield (held * held).T @ mask
    yield held.T @ held
    yield odd.T @ mask


def _partial(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    size = len(centre)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((5, size, size))
        for batch in batches:
            raw = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            missing = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            values = np.stack(raw, axis=1)
            odd = ~np.isfinite(values) & ~missing
            values = np.where(missing | odd, np.nan, values - centre)
            for i, part in enumerate(_products(np.stack([values, odd.astype(float)]))):
                total[i] += part
        slot = TaskContext.get().partitionId() % SLOTS
        for r in range(0, size, SIDE):
            for c in range(0, size, SIDE):
                sums = np.ascontiguousarray(total[:, r: r + SIDE, c: c + SIDE]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([c], pa.int32()), pa.array([slot], pa.int32()), pa.array([sums], pa.binary())],
                                                 names=["row", "column", "slot", "sums"])

    return rows.mapInArrow(run, _SUMS)


def _added(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of equal keys added up, one at a time."""
    def run(batches):
        key, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["row", "column", "slot", "sums"])

        for batch in batches:
            for row, column, slot, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (row, column, slot if "slot" in keys else 0)
                part = np.frombuffer(sums)
                if now == key:
                    total += part
                    continue
                if key is not None:
                    yield out()
                key, total = now, part.copy()
        if key is not None:
            yield out()

    return blocks.repartition(*[col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, _SUMS)


def pair_sums(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Five square matrices over the pairs (row's column, other column): number of rows where both are present, and over those the
    sum, the sum of squares and the sum of products of values less a centre; last, values that aren't finite numbers."""
    rows = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.avg(F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}"))).alias(f"c{i}") for i in range(len(columns))]
    first = rows.limit(CENTRE_ROWS).agg(*finite).first()
    centre = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in first])
    partial = settle(_partial(rows, centre), "pair-sums")
    spark, out = df.sparkSession, np.zeros((5, len(columns), len(columns)))
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "64")  # blocks are long
    try:
        blocks = _added(_added(partial, ["row", "column", "slot"]), ["row", "column"]).collect()  # as many numbers as there are pairs
    finally:
        spark.conf.set(_BATCH, before)
    for r in blocks:
        high, wide = min(SIDE, len(columns) - r["row"]), min(SIDE, len(columns) - r["column"])
        out[:, r["row"]: r["row"] + high, r["column"]: r["column"] + wide] = np.frombuffer(r["sums"]).reshape(5, high, wide)
    return out


def pearson_of_pairs(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlations over the rows where both columns are present; NaN where one of them is constant there, or not finite."""
    n, s, q, p, odd = pair_sums(df, columns)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = q - s * s / n
        spread = np.where(spread <= 1e-13 * q + 1e-300, np.nan, spread)
        r = (p - s * s.T / n) / np.sqrt(spread * spread.T)
    return np.where(odd + odd.T > 0, np.nan, r)

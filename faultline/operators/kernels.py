"""Kernel maps that let the distributed linear SVM act as a kernel SVM (K3-K5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from faultline.operators.ranks import keep_first


def _mapped(df: DataFrame, apply: Callable[[np.ndarray], np.ndarray], x: str, out: str) -> DataFrame:
    @pandas_udf("array<double>")
    def transform(batch: pd.Series) -> pd.Series:
        return pd.Series(list(apply(np.stack(batch.to_numpy()).astype(float))), index=batch.index)

    return df.withColumn(out, transform(x))


@dataclass(frozen=True)
class FourierMap:
    """K3: random Fourier features for exp(-gamma |a-b|^2)."""

    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, width: int, gamma: float, size: int = 256, seed: int = 0) -> "FourierMap":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(scale=np.sqrt(2 * gamma), size=(width, size)), rng.uniform(0, 2 * np.pi, size))

    def apply(self, a: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.phases.size) * np.cos(a @ self.weights + self.phases)

    def transform(self, df: DataFrame, x: str = "x", out: str = "x") -> DataFrame:
        return _mapped(df, self.apply, x, out)


def polynomial(gamma: float, degree: int = 3, coef0: float = 0.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: (gamma * (a @ b.T) + coef0) ** degree


def sigmoid(gamma: float, coef0: float = 0.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: np.tanh(gamma * (a @ b.T) + coef0)


@dataclass(frozen=True)
class LandmarkMap:
    """K4, K5: Nystroem map phi(x) = k(x, L) U S^(-1/2) from m landmark rows; negative eigenvalues,
    which an indefinite kernel can have, are clipped.

    ``m`` is the number of training rows that the map is fitted on. They and their m x m kernel matrix are held
    by the driver and sent to the tasks.
    """

    landmarks: np.ndarray
    projection: np.ndarray
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]

    @classmethod
    def fit(cls, df: DataFrame, kernel: Callable, m: int = 128, seed: int = 0, x: str = "x", id_col: str = "id") -> "LandmarkMap":
        rows = keep_first(df.select(id_col, x), m, seed, [F.col(id_col)]).select(x).collect()
        points = np.array([r[0] for r in rows], dtype=float)
        values, vectors = np.linalg.eigh(kernel(points, points))
        kept = values > 1e-10 * max(values.max(), 1e-300)
        return cls(points, vectors[:, kept] / np.sqrt(values[kept]), kernel)

    def apply(self, a: np.ndarray) -> np.ndarray:
        return self.kernel(a, self.landmarks) @ self.projection

    def transform(self, df: DataFrame, x: str = "x", out: str = "x") -> DataFrame:
        return _mapped(df, self.apply, x, out)


def default_gamma(df: DataFrame, width: int, x: str = "x") -> float:
    """1 / (features x variance of all feature values)."""
    spread = df.select(F.explode(x).alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (width * spread) if spread else 1.0 / width

"""Correlations in one pass against pandas, and ranks on keys of any distribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import cleansing, gram, ranks, sampling


@pytest.mark.parametrize("side", [64, 3])
def test_pairwise_correlations(spark, monkeypatch, side):
    monkeypatch.setattr(gram, "SIDE", side)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)) @ rng.standard_normal((8, 8)) + 1e6 * np.arange(8)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5] = 7.25  # constant
    x[:, 7] = x[:, 0] * 2
    x[300:, 6] = np.nan
    x[:300, 4] = np.nan  # never together with column 6 ...
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(8)])
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{i}` double" for i in range(8))).repartition(7)
    found, want = cleansing.correlations(df), frame.corr()
    for (a, b), r in found.items():
        expected = want.loc["c" + a[2:], "c" + b[2:]]
        assert (r is None) == bool(np.isnan(expected)) and (r is None or abs(r - expected) < 1e-9), (a, b, r, expected)
    assert len(found) == 28 and found["c.4", "c.6"] is None and round(found["c.0", "c.7"], 12) == 1.0
    assert cleansing.correlated_columns(df) == ["c.7"]
    assert cleansing.correlations(df.limit(0)) == dict.fromkeys(found) and cleansing.correlations(df.select("`c.1`")) == {}


def test_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(float(i), float(i), float("nan") if i == 3 else float(i), float("inf") if i == 4 else float(i), None if i == 3 else float(i)) for i in range(9)],
                               "a double, b double, c double, d double, e double")
    found = cleansing.correlations(df)
    assert found["a", "b"] == pytest.approx(1) and found["a", "c"] is None and found["a", "d"] is None and found["a", "e"] == pytest.approx(1)
    assert found["c", "e"] == pytest.approx(1)  # the row of the NaN has no e


@pytest.mark.parametrize("kind", ["hashes", "dense", "skewed", "equal"])
def test_ranks_of_any_numbers(spark, kind):
    rng = np.random.default_rng(5)
    n = 4_000
    v = {"hashes": rng.integers(0, 1 << 62, n), "dense": rng.permutation(n), "skewed": (np.exp(rng.standard_normal(n) * 8)).astype(np.int64), "equal": np.full(n, 3)}[kind]
    s = np.where(rng.random(n) < 0.9, "big", "small")
    df = spark.createDataFrame([(a, int(b)) for a, b in zip(s.tolist(), v.tolist(), strict=True)] + [(None, 5), ("big", None)], "s string, v long").repartition(6)
    got = ranks.value_rank(df.filter("s IS NOT NULL"), ["s"], "v", 50).toPandas()
    for name, part in got.groupby("s"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert part["v"].dropna().is_monotonic_increasing and (part["v"].isna().sum() == (name == "big")) and (name != "big" or pd.isna(part["v"].iloc[0]))


def test_no_slice_is_crowded(spark):
    """Hashed ids: slices are neither single rows nor a whole class."""
    df = spark.range(20_000).select(F.lit("s").alias("s"), F.pmod(F.xxhash64("id"), F.lit(1 << 62)).alias("v"))
    cuts = df.groupBy("s").agg(F.percentile_approx("v", F.array(*[F.lit(i / ranks.SPLITTERS) for i in range(1, ranks.SPLITTERS)]), F.lit(10_000)).alias("c"))
    sizes = [r["count"] for r in df.join(cuts, "s").groupBy(ranks._place(F.col("c"), F.col("v")).alias("p")).count().collect()]
    assert len(sizes) == ranks.SPLITTERS and max(sizes) < 4 * 20_000 / ranks.SPLITTERS
    ordered = sampling.assign_folds(df.withColumn("label", F.when(F.col("v") % 3 == 0, 1).otherwise(-1)), 5, ["v"], shuffle_seed=None)
    assert ordered.groupBy("fold").count().count() == 5

"""Interval joins read and shuffle only what lies near an interval."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import windows

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


@pytest.fixture()
def tables(spark, tmp_path):
    rng = random.Random(1)
    samples = [(rng.choice(["m", "n"]), at(rng.randrange(1_000_000)), float(i)) for i in range(4_000)]
    spark.createDataFrame(samples, "k string, ts timestamp_ntz, v double").write.parquet(f"{tmp_path}/samples")
    spans = [(rng.choice(["m", "n", "o"]), at(s := rng.randrange(300_000, 400_000)), at(s + rng.choice([0, 50, 5_000])), i) for i in range(30)]
    spans += [("m", at(350_000), at(349_000), 98), ("m", at(350_000), at(352_000), 99), ("m", at(350_000), at(352_000), 99)]
    return spark.read.parquet(f"{tmp_path}/samples"), samples, spark.createDataFrame(spans, "k string, low timestamp_ntz, high timestamp_ntz, i int"), spans


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("touched", [10 ** 6, 0])
def test_equals_definition(tables, monkeypatch, how, touched):
    monkeypatch.setattr(windows, "TOUCHED", touched)
    df, samples, intervals, spans = tables
    got = sorted((r["i"], r["v"] if r["v"] is not None else -1.0) for r in windows.interval_join(df, intervals, ["k"], "ts", "low", "high", 3600, how=how).collect())
    want = [(i, v) for k, low, high, i in spans for key, ts, v in samples if key == k and low <= ts <= high]
    if how == "left":
        want += [(i, -1.0) for k, low, high, i in spans if not any(key == k and low <= ts <= high for key, ts, _ in samples)]
    assert got == sorted(want)


def test_plan_prunes_before_the_shuffle(tables):
    df, samples, intervals, _ = tables
    joined = windows.interval_join(df, intervals, ["k"], "ts", "low", "high", 3600)
    text = plan(joined)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-04" in text and "LeftSemi" in text
    kept = df.filter(F.col("ts").between(at(300_000), at(405_000))).count()
    assert kept < 0.2 * len(samples)


def test_no_intervals(tables):
    df, _, intervals, _ = tables
    for how in ("inner", "left"):
        none = windows.interval_join(df, intervals.limit(0), ["k"], "ts", "low", "high", 3600, how=how)
        assert none.count() == 0 and set(none.columns) == {"k", "ts", "v", "low", "high", "i"}

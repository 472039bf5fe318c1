"""Two-level scans against the plain definitions."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions.times import epoch_us, from_epoch_us
from faultline.operators import fill, labels, ordered, resample
from faultline.params import Horizon

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def series(spark, values, machine="m", step=100.0):
    rows = [(machine, at(i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz, v double")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("machine_id", "ts").collect()]


def random_series(seed, n=300, missing=0.7):
    rng = random.Random(seed)
    return [None if rng.random() < missing else float(rng.randint(0, 9)) for _ in range(n)]


def test_epoch_round_trip(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 123456),), (dt.datetime(1969, 12, 31, 23, 59, 58, 250000),), (dt.datetime(2024, 1, 1, 0, 0, 59, 999999),)], "t timestamp_ntz")
        back = df.select("t", from_epoch_us(epoch_us(F.col("t"))).alias("b"), epoch_us(F.col("t")).alias("us")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert all(r["t"] == r["b"] for r in back)
    assert back[0]["us"] == 1710037800123456


@pytest.mark.parametrize("limit", [None, 1, 2, 5])
def test_forward_fill_equals_pandas(spark, limit):
    data = random_series(1)
    got = values(fill.forward_fill(series(spark, data), ["v"], limit=limit, slot_seconds=1000))
    want = pd.Series(data, dtype=float).ffill(limit=limit)
    assert [None if x is None else x for x in got] == [None if math.isnan(x) else x for x in want]


def test_forward_fill_limit_zero_fills_nothing(spark):
    data = [1.0, None, None, 2.0]
    assert values(fill.forward_fill(series(spark, data), ["v"], limit=0, slot_seconds=150)) == data


def test_forward_fill_is_idempotent(spark):
    once = fill.forward_fill(series(spark, random_series(2)), ["v"], slot_seconds=700)
    assert values(once) == values(fill.forward_fill(once, ["v"], slot_seconds=300))


@pytest.mark.parametrize("limit", [None, 2])
def test_linear_equals_pandas(spark, limit):
    data = random_series(3)
    got = values(fill.interpolate(series(spark, data), ["v"], "linear", limit=limit, slot_seconds=900))
    want = pd.Series(data, dtype=float).interpolate(method="linear", limit=limit)
    np.testing.assert_allclose([math.nan if x is None else x for x in got], want.to_numpy())


def test_time_equals_pandas(spark):
    rng = random.Random(4)
    moments = sorted(rng.sample(range(20_000), 120))
    data = [None if rng.random() < 0.6 else float(rng.randint(0, 9)) for _ in moments]
    df = spark.createDataFrame([("m", at(s), v) for s, v in zip(moments, data)], "machine_id string, ts timestamp_ntz, v double")
    want = pd.Series(data, index=pd.DatetimeIndex([at(s) for s in moments]), dtype=float).interpolate(method="time")
    got = values(fill.interpolate(df, ["v"], "time", slot_seconds=1500))
    np.testing.assert_allclose([math.nan if x is None else x for x in got], want.to_numpy())


def test_markers_are_missing(spark):
    df = spark.createDataFrame([("m", at(0), float("nan"), ""), ("m", at(1), -1e40, "x"), ("m", at(2), None, None)],
                               "machine_id string, ts timestamp_ntz, v double, s string")
    rows = fill.replace_extreme(fill.normalise_missing(df), ["v"]).orderBy("ts").collect()
    assert [(r["v"], r["s"]) for r in rows] == [(None, "x")]


def test_unknown_methods_are_refused(spark):
    with pytest.raises(ValueError):
        fill.impute(series(spark, [1.0]), string_method="linear")
    with pytest.raises(ValueError):
        fill.impute(series(spark, [1.0]), numeric_method="cubic")


@pytest.mark.parametrize("seconds", [600, 700])
def test_resample_equals_pandas(spark, seconds):
    rng = random.Random(5)
    moments = sorted(rng.sample(range(30_000), 200))
    data = [None if rng.random() < 0.5 else float(i) for i, _ in enumerate(moments)]
    df = spark.createDataFrame([("m", at(s), v) for s, v in zip(moments, data)], "machine_id string, ts timestamp_ntz, v double")
    got = resample.resample_last(df, seconds, ["v"]).orderBy("ts").collect()
    want = pd.Series(data, index=pd.DatetimeIndex([at(s) for s in moments]), dtype=float).resample(f"{seconds}s").last().shift(1)
    assert [r["ts"] for r in got] == list(want.index.to_pydatetime())
    np.testing.assert_allclose([math.nan if r["v"] is None else r["v"] for r in got], want.to_numpy())


def test_resample_bin_edges(spark):
    got = resample.resample_last(series(spark, [1.0, 2.0, None, 4.0, 5.0], step=30), 60, ["v"]).orderBy("ts").collect()
    # A value on an edge opens the next bin; the first row is empty; what the last bin holds is not shown.
    assert [r["v"] for r in got] == [None, 2.0, 4.0]


def test_asof_equals_pandas(spark):
    rng = random.Random(6)
    moments = sorted(rng.sample(range(50_000), 80))
    data = [None if rng.random() < 0.3 else float(i) for i, _ in enumerate(moments)]
    df = spark.createDataFrame([("m", at(s), v) for s, v in zip(moments, data)], "machine_id string, ts timestamp_ntz, v double")
    want = pd.Series(data, index=pd.DatetimeIndex([at(s) for s in moments]), dtype=float).asfreq("300s", method="ffill")
    got = resample.resample_asof(df, 300, ["v"]).orderBy("ts").collect()
    assert [r["ts"] for r in got] == list(want.index.to_pydatetime())
    np.testing.assert_allclose([math.nan if r["v"] is None else r["v"] for r in got], want.to_numpy())


def test_scan_equals_one_window(spark):
    df = series(spark, random_series(7, 400)).unionByName(series(spark, random_series(8, 150), machine="n"))
    w = "OVER (PARTITION BY machine_id ORDER BY ts"
    want = df.selectExpr(
        "machine_id", "ts", f"last_value(v, true) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b",
        f"first_value(v, true) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n",
        f"first_value(v, true) {w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a", f"row_number() {w}) AS p")
    got = ordered.scan(df, ["machine_id"], before={"b": F.col("v")}, next={"n": F.col("v")}, after={"a": F.col("v")}, position="p", slot_seconds=1100)
    columns = ["machine_id", "ts", "b", "n", "a", "p"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == 550


@pytest.mark.parametrize("slot_rows", [1, 7, 50])
def test_crowded_slots_are_split(spark, slot_rows):
    rng = random.Random(9)
    # Two thirds of all rows lie within three seconds of one machine.
    moments = sorted({rng.randint(0, 3_000_000) for _ in range(200)} | {rng.randint(0, 20_000) * 1_000_000 for _ in range(100)})
    rows = [("hot", at(us / 1e6), float(i) if i % 4 == 0 else None) for i, us in enumerate(moments)] + [("m", at(i), None) for i in range(5)]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz, v double")
    slotted = ordered.with_slots(df, ["machine_id"], epoch_us(F.col("ts")), 3600, slot_rows)
    assert max(r["count"] for r in slotted.groupBy("machine_id", "__slot").count().collect()) <= slot_rows
    edges = slotted.groupBy("machine_id", "__slot").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).filter("machine_id = 'hot'").orderBy("__slot").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:]))
    got = [r["f"] for r in ordered.scan(df, ["machine_id"], last={"f": F.col("v")}, slot_rows=slot_rows).filter("machine_id = 'hot'").orderBy("ts").collect()]
    want = pd.Series([r[2] for r in rows if r[0] == "hot"], dtype=float).ffill()
    np.testing.assert_allclose(got, want.to_numpy())


def greedy(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or kept[-1] < t - gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("fold_limit", [0, 5, 4096])
@pytest.mark.parametrize("density", [50, 400, 2500])
def test_thinning_equals_loop(spark, density, fold_limit):
    rng = random.Random(density)
    moments = sorted(rng.sample(range(100_000), density))
    df = spark.createDataFrame([(m, at(s), 351) for m in ("a", "b") for s in moments if m == "a" or s % 3], "machine_id string, ts timestamp_ntz, code int")
    got = labels.positive_examples(df, 351, Horizon(300, 200), fold_limit=fold_limit)
    for machine in ("a", "b"):
        own = sorted(r["ts"] for r in got.filter(F.col("machine_id") == machine).collect())
        assert own == [at(s) for s in greedy([s for s in moments if machine == "a" or s % 3], 500)]


def test_thinning_is_strict(spark):
    df = spark.createDataFrame([("m", at(s), 1) for s in (0, 500, 501, 1001)], "machine_id string, ts timestamp_ntz, code int")
    got = sorted(r["ts"] for r in labels.positive_examples(df, 1, Horizon(300, 200)).collect())
    assert got == [at(0), at(501)]


def test_no_errors_give_no_examples(spark):
    df = spark.createDataFrame([("m", at(0), 5)], "machine_id string, ts timestamp_ntz, code int")
    assert labels.positive_examples(df, 1, Horizon()).count() == 0


def test_negatives_keep_inclusive_bounds(spark):
    rows = [("m", at(0), 1), ("m", at(299), 2), ("m", at(300), 2), ("m", at(400), 2), ("m", at(500), 2), ("m", at(501), 2), ("m", at(502), None)]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz, code int")
    got = sorted(r["ts"] for r in labels.negative_candidates(df, 1, Horizon(300, 200), slot_seconds=100).collect())
    assert got == [at(299), at(501), at(502)]


def test_run_lengths(spark):
    codes = [7, 7, 1, 7, 7, 7, None, 7]
    df = spark.createDataFrame([("m", at(i * 10), c) for i, c in enumerate(codes)], "machine_id string, ts timestamp_ntz, c int")
    got = labels.consecutive(df, "c", 7, slot_seconds=25).orderBy("ts").collect()
    assert [r["c.7.consecutiveErrors"] for r in got] == [1, 2, 0, 1, 2, 3, 0, 1]


def test_slice_drops_late_columns_on_request(spark):
    rows = [("m", at(i * 10), 1.0 if i >= 1 else None, 1.0 if i >= 50 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz, a double, late double")
    assert fill.slice_valid(df).count() == 10
    kept = fill.slice_valid(df, max_late_start=100)
    assert kept.count() == 59 and "late" not in kept.columns

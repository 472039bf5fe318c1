"""Reading windows and features on small cases."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import catalogue, features, labels, windows
from faultline.params import Horizon

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def test_window_bounds_are_inclusive(spark):
    samples = spark.createDataFrame([("m", at(s), float(s)) for s in (0, 99, 100, 150, 200, 201, 300)], "machine_id string, ts timestamp_ntz, value double")
    examples = windows.with_windows(spark.createDataFrame([("m", at(400))], "machine_id string, ts timestamp_ntz"), Horizon(200, 100))
    got = windows.window_samples(samples, examples, 100)
    assert sorted(r["value"] for r in got.collect()) == [100.0, 150.0, 200.0]


@pytest.mark.parametrize("width", [7, 60, 5000])
def test_interval_join_equals_nested_loops(spark, width):
    rng = random.Random(width)
    samples = [("ab"[rng.random() < 0.8], at(rng.randint(0, 3000)), i) for i in range(600)]
    spans = [("ab"[rng.random() < 0.5], at(lo := rng.randint(0, 3000)), at(lo + rng.randint(0, 120)), i) for i in range(60)]
    s = spark.createDataFrame(samples, "k string, ts timestamp_ntz, s int")
    iv = spark.createDataFrame(spans, "k string, lo timestamp_ntz, hi timestamp_ntz, i int")
    got = sorted((r["s"], r["i"]) for r in windows.interval_join(s, iv, ["k"], "ts", "lo", "hi", width).collect())
    assert got == sorted((a[2], b[3]) for a in samples for b in spans if a[0] == b[0] and b[1] <= a[1] <= b[2])
    half = sorted((r["s"], r["i"]) for r in windows.interval_join(s, iv, ["k"], "ts", "lo", "hi", width, high_inclusive=False).collect())
    assert half == sorted((a[2], b[3]) for a in samples for b in spans if a[0] == b[0] and b[1] <= a[1] < b[2])


def test_interval_join_has_no_nested_loop(spark):
    s = spark.createDataFrame([("a", at(0))], "k string, ts timestamp_ntz")
    iv = spark.createDataFrame([("a", at(0), at(5))], "k string, lo timestamp_ntz, hi timestamp_ntz")
    plan = windows.interval_join(s, iv, ["k"], "ts", "lo", "hi", 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_windows(spark):
    samples = spark.createDataFrame([("m", at(100))], "machine_id string, ts timestamp_ntz")
    examples = windows.with_windows(spark.createDataFrame([("m", at(400)), ("m", at(4000))], "machine_id string, ts timestamp_ntz"), Horizon(200, 100))
    assert windows.samples_used(samples, examples, 100).count() == 1
    kept = windows.samples_used(samples, examples, 100, drop_empty=False)
    assert sorted(r["samples_used"] for r in kept.collect()) == [0, 1]


def test_rows_with_missing_features_are_not_stored(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 2.0)], "k int, `a__mean` double, `b__mean` double")
    assert [r["k"] for r in windows.storable(df, ["a__mean", "b__mean"]).collect()] == [2]


def pairs(spark, seed=1, n=64, series=("s", "t")):
    rng = random.Random(seed)
    rows = [("e", s, at(i * 10), rng.choice([rng.random() * 10, float(rng.randint(0, 4))])) for s in series for i in range(n)]
    return rows, spark.createDataFrame(rows, "example string, series string, ts timestamp_ntz, value double")


BY = ["example", "series"]


def vector(rows, series):
    return np.array([r[3] for r in rows if r[1] == series])


def by_series(df):
    return {r["series"]: r for r in df.collect()}


def test_minimal_features(spark):
    rows, df = pairs(spark)
    got = by_series(features.minimal_features(df, BY))
    for s in ("s", "t"):
        x = vector(rows, s)
        want = [x.sum(), np.median(x), x.mean(), x.size, x.std(), x.var(), x.max(), x.min()]
        np.testing.assert_allclose([got[s][n] for n in features.MINIMAL], want)
    assert len(features.MINIMAL) == 8


def test_category_features_equal_dense_ones(spark):
    dense = [("e", "c", at(i), v) for i, v in enumerate([1.0, 0.0, 0.0, 1.0])] + [("e", "d", at(i), 0.0) for i in range(4)]
    want = by_series(features.minimal_features(spark.createDataFrame(dense, "example string, series string, ts timestamp_ntz, value double"), BY))
    counts = spark.createDataFrame([("e", "c", 4, 2), ("e", "d", 4, None)], "example string, series string, n int, ones int")
    got = by_series(features.indicator_features(counts))
    for s in "cd":
        np.testing.assert_allclose([got[s][n] for n in features.MINIMAL], [want[s][n] for n in features.MINIMAL])


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 5.0, "k"), (3.0, 5.0, "l")], "a double, b double, id string")
    assert sorted(tuple(r) for r in features.standardise(df, ["a", "b"]).collect()) == [(-1.0, 0.0, "k"), (1.0, 0.0, "l")]
    vectors = features.assemble(df, ["a", "b"])
    for kind in ("min_max", "robust", "max_abs"):
        assert features.scale_vectors(vectors, kind).count() == 2
    with pytest.raises(ValueError):
        features.scale_vectors(vectors, "none")


def test_metadata_and_labels(spark):
    df = spark.createDataFrame([(1, T0, 2.0, 3, 351), (2, T0, 2.0, 3, 17)], "samples_used int, window_start timestamp_ntz, `s__mean` double, `s__length` int, code int")
    kept = features.drop_metadata(df)
    assert kept.columns == ["s__mean", "code"]
    assert sorted(r["label"] for r in features.with_label(kept, "code", 351).collect()) == [-1, 351]


def test_wide_and_sparse_forms_agree(spark):
    _, df = pairs(spark)
    found = features.minimal_features(df, BY)
    long = features.features_long(found, BY)
    wide = features.features_wide(found, BY, ["s", "t"]).first()
    index = features.feature_index(long)
    order = [r["feature"] for r in index.orderBy("position").collect()]
    packed = features.assemble_long(long, ["example"], index, len(order)).first()["features"]
    np.testing.assert_allclose(packed.toArray(), [wide[f] for f in order])


def test_plain_features(spark):
    rows, df = pairs(spark)
    got = by_series(catalogue.plain_features(df, BY, quantiles=(0.3,)))
    for s in ("s", "t"):
        x = pd.Series(vector(rows, s))
        r = got[s]
        np.testing.assert_allclose([r["abs_energy"], r["skewness"], r["kurtosis"], r["quantile__q_0_3"]], [(x ** 2).sum(), x.skew(), x.kurt(), x.quantile(0.3)])
        assert r["ratio_beyond_r_sigma__r_1_0"] == pytest.approx((abs(x - x.mean()) > x.std(ddof=0)).mean())


def test_constant_windows(spark):
    df = spark.createDataFrame([("e", "s", at(i), 2.0) for i in range(6)], "example string, series string, ts timestamp_ntz, value double")
    plain = catalogue.plain_features(df, BY).first()
    assert plain["skewness"] == plain["kurtosis"] == 0.0
    trend = catalogue.trend_features(df, BY).first()
    assert trend["autocorrelation__lag_1"] is None and trend["binned_entropy"] == 0.0 and trend["linear_trend__slope"] == 0.0
    assert catalogue.difference_features(df, BY).first()["cid_ce__normalize_True"] == 0.0


def test_difference_features(spark):
    rows, df = pairs(spark)
    got = by_series(catalogue.difference_features(df, BY))
    for s in ("s", "t"):
        x, r = vector(rows, s), got[s]
        assert r["mean_change"] == pytest.approx((x[-1] - x[0]) / (x.size - 1))
        assert r["c3__lag_2"] == pytest.approx((x[4:] * x[2:-2] * x[:-4]).mean())
        assert r["time_reversal_asymmetry_statistic__lag_1"] == pytest.approx((x[2:] ** 2 * x[1:-1] - x[1:-1] * x[:-2] ** 2).mean())
        assert r["first_location_of_maximum"] == pytest.approx(x.argmax() / x.size)
        assert r["last_location_of_minimum"] == pytest.approx(1 - x[::-1].argmin() / x.size)
        lo, hi = np.quantile(x, [0.2, 0.8])
        inside = (x >= lo) & (x <= hi)
        steps = abs(np.diff(x))[inside[1:] & inside[:-1]]
        assert r["change_quantiles__ql_0_2__qh_0_8__isabs_True__f_agg_var"] == pytest.approx(steps.var())


def test_peaks_and_strikes(spark):
    values = [0.0, 5.0, 0.0, 9.0, 1.0, 1.0, 1.0, 8.0, 8.0]
    df = spark.createDataFrame([("e", "s", at(i), v) for i, v in enumerate(values)], "example string, series string, ts timestamp_ntz, value double")
    r = catalogue.run_features(df, BY).first()
    assert (r["number_peaks__n_1"], r["number_peaks__n_3"], r["longest_strike_above_mean"], r["longest_strike_below_mean"]) == (2, 1, 2, 3)


def test_trend_features(spark):
    rows, df = pairs(spark, n=57)
    got = by_series(catalogue.trend_features(df, BY))
    for s in ("s", "t"):
        x, r = vector(rows, s), got[s]
        slope, intercept = np.polyfit(np.arange(x.size), x, 1)
        assert r["linear_trend__slope"] == pytest.approx(slope) and r["linear_trend__intercept"] == pytest.approx(intercept)
        d = x - x.mean()
        assert r["autocorrelation__lag_3"] == pytest.approx((d[3:] * d[:-3]).sum() / ((x.size - 3) * x.var()))
        parts = np.array_split(x, 10)
        assert r["energy_ratio_by_chunks__num_10__focus_8"] == pytest.approx((parts[8] ** 2).sum() / (x ** 2).sum())
        mass = np.cumsum(abs(x)) / abs(x).sum()
        assert r["index_mass_quantile__q_0_5"] == pytest.approx((np.argmax(mass >= 0.5) + 1) / x.size)
        p = np.histogram(x, bins=10)[0] / x.size
        assert r["binned_entropy"] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum())


def test_vector_features(spark):
    rows, df = pairs(spark)
    got = by_series(catalogue.vector_features(df, BY))
    x = vector(rows, "s")
    assert got["s"]["fft_coefficient__attr_abs__coeff_3"] == pytest.approx(abs(sum(x * np.exp(-2j * np.pi * 3 * np.arange(x.size) / x.size))))
    wave = [("e", "s", at(i), 1.0 + 0.5 ** i) for i in range(40)]
    one = catalogue.vector_features(spark.createDataFrame(wave, "example string, series string, ts timestamp_ntz, value double"), BY).first()
    assert one["partial_autocorrelation__lag_0"] == 1.0
    # x_t = 0.5 + 0.5 x_{t-1} is reproduced by the fitted recursion.
    fitted = [one[f"ar_coefficient__k_10__coeff_{k}"] for k in range(11)]
    y = [w[3] for w in wave]
    assert fitted[0] + sum(c * y[20 - k] for k, c in enumerate(fitted[1:], 1)) == pytest.approx(y[20], abs=1e-6)


def test_all_features_in_one_row(spark):
    _, df = pairs(spark)
    got = catalogue.efficient_features(df, BY)
    assert got.count() == 2 and len(got.columns) == len(set(got.columns)) > 150


def test_balance_and_sampling(spark):
    assert labels.negatives_needed(3, 0.4) == 5 and labels.negatives_needed(4, 0.5) == 4
    df = spark.createDataFrame([("m", at(i)) for i in range(1000)], "machine_id string, ts timestamp_ntz")
    drawn = {r["ts"] for r in labels.sample_examples(df, 123, 5).collect()}
    assert len(drawn) == 123 and drawn == {r["ts"] for r in labels.sample_examples(df.repartition(7), 123, 5).collect()}
    assert labels.sample_examples(df, 5000, 5).count() == 1000 and labels.sample_examples(df, 0, 5).count() == 0


def test_processed_examples_are_skipped(spark):
    df = spark.createDataFrame([("m", at(i)) for i in range(5)], "machine_id string, ts timestamp_ntz")
    assert labels.not_processed(df, df.filter(F.col("ts") < at(3))).count() == 2

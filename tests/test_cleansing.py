"""Column and row filters, encodings."""

from __future__ import annotations

import datetime as dt

import pytest

from faultline.operators import cleansing, encode, fill, timeline

T0 = dt.datetime(2024, 1, 1)


def test_constant_columns(spark):
    rows = [(1, None, "a", "x", "x", "", 1.0), (2, None, "a", "Unavailable", "y", "", 1.0), (3, None, None, "x", "x", None, None)]
    df = spark.createDataFrame(rows, "k int, empty string, one string, off string, two string, blank string, num double")
    clean = fill.normalise_missing(df, ["k"])
    assert cleansing.constant_columns(clean) == ["empty", "one", "off", "blank", "num"]
    assert cleansing.constant_columns(clean, only_one=False) == ["empty", "off", "blank"]
    assert cleansing.constant_columns(clean, only_null_or_empty=False, only_one_and_unavailable=False) == ["one", "num"]
    assert cleansing.drop_constant_columns(clean, keep=["k", "num"]).columns == ["k", "two", "num"]


def test_two_plain_values_stay_when_one_lies_between(spark):
    df = spark.createDataFrame([("A",), ("UNAVAILABLE",), ("B",)], "s string")
    assert cleansing.constant_columns(df) == []


def test_correlation_keeps_the_first(spark):
    df = spark.range(50).selectExpr("id AS a", "id * 2 AS b", "-id AS c", "id % 7 AS d", "id AS `x.errorCode`", "cast(null as double) AS e")
    assert cleansing.drop_correlated(df).columns == ["a", "d", "x.errorCode", "e"]


def test_modes():
    with pytest.raises(ValueError):
        cleansing.check_modes({"door_state": ["ALL", "CLOSED"]})
    with pytest.raises(ValueError):
        cleansing.check_modes({"door_state": ["OPEN"]})
    assert cleansing.check_modes({"door_state": ["ALL"]}) == {}


def test_mode_filter(spark):
    df = spark.createDataFrame([(1, "READY", "STOPPED", "CLOSED"), (2, "STOPPED", "READY", "CLOSED"), (3, "READY", "READY", "UNLATCHED"), (4, None, "STOPPED", "CLOSED")],
                               "k int, `components.path1.events.exec.state` string, `components.path2.events.exec2.state` string, `components.door1.events.door.state` string")
    got = cleansing.filter_modes(df, {"path_execution_state": ["READY"], "door_state": ["CLOSED"], "path_mode": ["MANUAL"]})
    assert sorted(r["k"] for r in got.collect()) == [1, 2]
    assert cleansing.filter_modes(df, {"path_mode": ["MANUAL"]}).count() == 4


def test_outliers(spark):
    rows = [(float(i % 5), 1.0) for i in range(40)] + [(1000.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert cleansing.drop_outliers(df, 3, "any").count() == 41
    assert cleansing.drop_outliers(df, 3, "all").count() == 42
    with pytest.raises(ValueError):
        cleansing.drop_outliers(df, 3, "some")


def test_one_hot(spark):
    rows = [("m", T0, "on", 1.0, 351, 7), ("m", T0 + dt.timedelta(1), "off", 2.0, None, 7), ("m", T0 + dt.timedelta(2), None, 3.0, 351, None)]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz, state string, v double, `t.errorCode` int, `o.errorCode` int")
    wide = encode.one_hot(df, "t.errorCode")
    assert wide.columns == ["machine_id", "ts", "v", "t.errorCode", "state.off", "state.on", "o.errorCode.7"]
    assert [tuple(r)[4:] for r in wide.orderBy("ts").collect()] == [(0, 1, 1), (1, 0, 1), (0, 0, 0)]
    long = encode.one_hot_long(df, ["state", "o.errorCode"])
    assert sorted(r["series"] for r in long.collect()) == ["o.errorCode.7", "o.errorCode.7", "state.off", "state.on"]
    literal = encode.one_hot(df, "t.errorCode", string_nulls="literal")
    assert "state.nan" in literal.columns
    vectors = encode.one_hot_vectors(df, ["state"]).orderBy("ts").collect()
    assert [list(r["state_vec"]) for r in vectors] == [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def test_occurrence(spark):
    df = spark.createDataFrame([("m", T0, 1.0), ("m", T0 + dt.timedelta(1), None)], "machine_id string, ts timestamp_ntz, `c.errorCode` double")
    got = encode.error_occurrence(df).orderBy("ts").collect()
    assert [r["c.errorCode_1_occured"] for r in got] == [1, 0]


def test_error_codes_are_kept_by_default(spark):
    df = spark.createDataFrame([(1, 2)], "`a.errorCode` int, `b.errorCode` int")
    assert cleansing.drop_error_codes(df, "a.errorCode").columns == df.columns
    assert cleansing.drop_error_codes(df, "a.errorCode", skip=False).columns == ["a.errorCode"]


def test_text_columns(spark):
    df = spark.createDataFrame([(1, None, True)], "k int, s string, b boolean")
    assert [tuple(r) for r in timeline.objects_to_text(df).collect()] == [(1, None, "true")]
    assert [tuple(r) for r in timeline.objects_to_text(df, string_nulls="literal").collect()] == [(1, "nan", "true")]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A key with most of the rows must not be sorted in one task: the first step is a partial aggregate."""
    df = spark.range(1000).selectExpr("if(id % 3 > 0, 0, id) AS machine_id", "0 AS ts", "id AS row", "id AS v")
    kept = timeline.first_per_timestamp(df, ["row"])
    assert kept.filter("machine_id = 0").first()["v"] == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan

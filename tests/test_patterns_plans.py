"""Mining on small cases and the jobs from end to end."""

from __future__ import annotations

import datetime as dt
import gzip
import itertools
import json
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import patterns
from faultline.params import OK_CODE, Horizon, MiningParams, PredictionParams
from faultline.plans import prediction

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def coded(spark, codes, step=600):
    return spark.createDataFrame([("f", at(i * step), c) for i, c in enumerate(codes)], "source_file string, ts timestamp_ntz, code bigint")


def test_runs(spark):
    codes = [OK_CODE, 5, 5, 6, 6, 6, 5, OK_CODE, 6]
    got = sorted((r["run_start"], r["run_end"], r["code"]) for r in patterns.error_runs(coded(spark, codes)).collect())
    assert got == [(at(600), at(1200), 5), (at(1800), at(3000), 6), (at(3600), at(3600), 5), (at(4800), at(4800), 6)]


def test_run_lengths_sum_to_the_rows(spark):
    rng = random.Random(1)
    codes = [rng.choice([OK_CODE, 1, 2]) for _ in range(500)]
    df = coded(spark, codes)
    runs = patterns.error_runs(df, slot_seconds=1700)
    inside = df.alias("d").join(runs.alias("r"), (F.col("d.code") == F.col("r.code")) & F.col("d.ts").between(F.col("run_start"), F.col("run_end")))
    assert inside.count() == sum(c != OK_CODE for c in codes)
    assert runs.count() == sum(c != OK_CODE and (i == 0 or codes[i - 1] != c) for i, c in enumerate(codes))


def test_gaps_over_a_day_count_in_full(spark):
    rows = [("f", at(0), 5), ("f", at(10), OK_CODE), ("f", at(86_400 + 5), 5), ("f", at(86_400 + 6), OK_CODE), ("f", at(86_400 + 1005), 5), ("f", at(86_400 + 1006), OK_CODE), ("f", at(86_400 + 2006), 5)]
    df = spark.createDataFrame(rows, "source_file string, ts timestamp_ntz, code bigint")
    kept = sorted(r["run_start"] for r in patterns.spaced_runs(patterns.error_runs(df), 1000).collect())
    # first run; 86,405 s later; exactly 1000 s is not enough; 1001 s is.
    assert kept == [at(0), at(86_400 + 5), at(86_400 + 2006)]


def test_itemset_windows(spark):
    rows = [("f", at(s), c) for s, c in ((0, 9), (100, OK_CODE), (200, 7), (300, 7), (400, OK_CODE), (500, 5))]
    df = spark.createDataFrame(rows, "source_file string, ts timestamp_ntz, code bigint")
    runs = patterns.spaced_runs(patterns.error_runs(df), 0)
    got = {r["error_code"]: r for r in patterns.itemsets(df, runs, 400, 3, ["code"]).collect()}
    # The window of 5 starts at 100 (included); 7 has two rows before it, too few.
    assert set(got) == {5} and got[5]["n_rows"] == 4 and got[5]["items"] == [7]


def test_empty_itemsets_count_in_the_denominator(spark):
    windows = spark.createDataFrame([(5, [1, 2]), (5, [1, 2]), (5, []), (5, []), (6, [1])], "error_code bigint, items array<int>")
    got = {tuple(r["itemset"]): (r["support"], r["support_rel"]) for r in patterns.frequent_itemsets(windows, 0.5).collect()}
    assert got == {(1,): (2, 0.5), (2,): (2, 0.5), (1, 2): (2, 0.5)}  # code 6 has one window only
    assert patterns.frequent_itemsets(windows, 0.6).count() == 0


def brute(windows, support):
    found = {}
    for code in {c for c, _ in windows}:
        own = [set(i) for c, i in windows if c == code]
        if len(own) < 2:
            continue
        for size in range(1, 7):
            for combo in itertools.combinations(range(6), size):
                n = sum(set(combo) <= w for w in own)
                if n and n >= math.ceil(len(own) * support):
                    found[code, combo] = n
    return found


@pytest.mark.parametrize("support", [0.2, 0.5])
def test_itemsets_and_rules_equal_brute_force(spark, support):
    rng = random.Random(int(support * 10))
    windows = [(code, sorted(i for i in range(6) if rng.random() < 0.5)) for code, n in ((1, 3), (2, 40), (3, 150)) for _ in range(n)]
    df = spark.createDataFrame(windows, "error_code bigint, items array<int>")
    frequent = patterns.frequent_itemsets(df, support).cache()
    got = {(r["error_code"], tuple(r["itemset"])): r["support"] for r in frequent.collect()}
    want = brute(windows, support)
    assert got == want
    for (code, items), n in got.items():  # larger sets are never more frequent
        assert all(got[code, tuple(sorted(set(items) - {i}))] >= n for i in items if len(items) > 1)
    rules = {(r["error_code"], tuple(r["antecedent"]), tuple(r["consequent"])): r["confidence"] for r in patterns.association_rules(frequent, 0.3).collect()}
    expected = {}
    for (code, items), n in want.items():
        for size in range(1, len(items)):
            for left in itertools.combinations(items, size):
                if n / want[code, left] >= 0.3:
                    expected[code, left, tuple(sorted(set(items) - set(left)))] = n / want[code, left]
    assert rules == pytest.approx(expected)
    assert support > 0.2 or any(len(c) > 1 for _, _, c in rules)


def test_mining_job_keeps_files_apart(spark):
    rows = []
    for f in ("a", "b", "c"):
        for i in range(60):
            logic = 5 if i % 20 == 19 else OK_CODE
            rows.append((f, at(i * 60), None if i == 0 else logic, 8 if i % 20 > 15 else OK_CODE))
    df = spark.createDataFrame(rows, "source_file string, ts timestamp_ntz, `x.errorCode` bigint, `y.errorCode` bigint")
    frequent, rules = patterns.mine(df, MiningParams("x.errorCode", 300, 5, 600, True, 0.5, 0.5))
    got = {(r["error_code"], tuple(r["itemset"])): (r["n_windows"], r["support"]) for r in frequent.collect()}
    assert got == {(5, (8,)): (9, 9)}
    assert rules.count() == 0


def machine_log(spark, hours=60):
    """A log whose load rises in the hour before each error, on a 60 s raster."""
    rng = random.Random(0)
    rows = []
    for i in range(hours * 60):
        phase = i % 240
        near = 120 <= phase < 180
        rows.append(("m", at(i * 60 + rng.random()), rng.gauss(8.0 if near else 2.0, 1.0), rng.gauss(0.0, 1.0),
                     "ACTIVE" if near else rng.choice(["READY", "STOPPED", "ACTIVE"]), 351.0 if phase == 239 else 17.0, "same"))
    return spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz, `components.c.samples.load.value` double, `components.c.samples.noise.value` double, "
                                 "`components.path1.events.exec.state` string, `components.cont.conditions.logic.errorCode` double, `components.c.events.x.state` string")


def test_prediction_job(spark, tmp_path):
    p = PredictionParams(sampling_seconds=60, horizon=Horizon(3600, 3600), stored_horizons=(Horizon(3600, 3600),), folds=3, classifier="svm_linear", store_examples=True)
    got = prediction.run(machine_log(spark), p, f"{tmp_path}/results", f"{tmp_path}/store").collect()
    assert len(got) == 1 and got[0]["accuracy_mean"] > 0.8
    assert got[0]["tp"] + got[0]["fn"] == 15  # every error has a reading window
    assert spark.read.parquet(f"{tmp_path}/results").count() == 1


def test_cleansing_chain(spark):
    p = PredictionParams(sampling_seconds=60)
    clean = prediction.cleanse(machine_log(spark, 4), p)
    assert "components.c.events.x.state" not in clean.columns  # constant
    assert clean.filter(F.col("`components.c.samples.load.value`").isNull()).count() == 0
    given = prediction.window_input(clean, p)
    assert sorted(r["series"] for r in given.names.collect()) == [f"components.path1.events.exec.state.{s}" for s in ("ACTIVE", "READY", "STOPPED")]
    assert given.present.count() == clean.count()


def test_from_raw_dumps_to_the_global_frame(spark, tmp_path):
    def dump(name, *records):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("".join(json.dumps(r) for r in records))

    def record(t, load, state=None, machine="Integrex", seq=1):
        stamp = {"timestamp": {"$date": 1704067200000 + t * 1000}, "sequence": {"$numberLong": str(seq)}}
        component = {"id": "c", "samples": [{"id": "load", "value": load, **stamp}]}
        if state:
            component["events"] = [{"id": "exec", "state": state, **stamp}]
        return {"machineId": machine, "components": [component]}

    dump("a.json.gz", record(0, 1.0, "READY"), record(10, 2.0), record(10, 3.0, seq=2))
    dump("b.json.gz", record(20, 4.0, "ACTIVE"), record(30, 9.0, machine="VTC530C"))
    samples, bad = prediction.extract(spark, str(tmp_path), "Integrex")
    frame = prediction.global_frame(samples).orderBy("ts").collect()
    assert bad.count() == 0
    assert [(r["ts"], r["components.c.samples.load.value"], r["components.c.events.exec.state"]) for r in frame] == [
        (at(0), 1.0, "READY"), (at(10), 3.0, None), (at(20), 4.0, "ACTIVE")]


def test_rules_of_many_items_equal_a_plain_loop(spark):
    """35 items in one itemset and confidences that fall as consequents grow."""
    items = list(range(100, 135))
    rows = [(1, items, 5)] + [(1, [i], 5 if i % 7 == 0 else 1000) for i in items]
    rows += [(1, [i for i in items if i != j], 5) for j in items] + [(1, items[:2], 5), (1, [100, 107], 5), (2, [1], 9), (2, [2], 4), (2, [1, 2], 4)]
    frequent = spark.createDataFrame(rows, "error_code bigint, itemset array<int>, support bigint")
    support = {(c, tuple(s)): n for c, s, n in rows}
    expected = set()
    for code, whole, n in rows:
        for item in whole if len(whole) > 1 else []:
            left = tuple(x for x in whole if x != item)
            if (code, left) in support and n / support[code, left] >= 0.5:
                expected.add((code, left, (item,), n / support[code, left]))
    got = {(r["error_code"], tuple(r["antecedent"]), tuple(r["consequent"]), r["confidence"]) for r in patterns.association_rules(frequent, 0.5).collect()}
    assert got == expected and any(len(a) == 34 for _, a, _, _ in got)


def test_every_option_of_the_job_counts(spark, tmp_path):
    """Scaler, extended features, classifier options, ensemble and store bounds change what a run gives."""
    frame = machine_log(spark, 40)
    base = dict(sampling_seconds=60, folds=2, classifier="svm_linear")
    p = PredictionParams(**base)
    codes = prediction.labels.code_series(frame, p.target_col).filter(F.col("code").isNotNull())
    given = prediction.window_input(prediction.cleanse(frame, p), p)
    examples = prediction.examples_for(codes, p)
    small = prediction.settle(prediction.example_features(given, examples, p.horizon), "small")
    large = prediction.settle(prediction.example_features(given, examples, p.horizon, minimal=False), "large")
    names = lambda df: {r["feature"] for r in df.select("feature").distinct().collect()}
    assert names(small) < names(large) and len(names(large)) > len(names(small)) + 50
    by_scaler = {}
    for scaler in ("standard", "min_max", "robust", "max_abs"):
        rows = prediction.matrix(small, PredictionParams(scaler=scaler, **base)).orderBy("id").collect()
        by_scaler[scaler] = [tuple(r["x"]) for r in rows]
    assert len({tuple(v) for v in by_scaler.values()}) == 4
    assert all(-1e-9 <= x <= 1 + 1e-9 for r in by_scaler["min_max"] for x in r)
    with pytest.raises(ValueError):
        prediction.matrix(small, PredictionParams(scaler="no such", **base))
    for bound, expected in ((3, 6), (None, 20)):
        path = f"{tmp_path}/store-{bound}"
        prediction.store_examples(given, codes, PredictionParams(stored_per_iteration=bound, store_examples=True, **base), path)
        kinds = [prediction.stores.stored_examples(spark, path, p.target_code, p.horizon, k) for k in (True, False)]
        assert sum(k.select("ts").distinct().count() for k in kinds) == expected
    voted = prediction.run(frame, PredictionParams(ensemble=("svm_linear", "logistic"), ensemble_seeds=(1, 2), **base)).collect()
    assert sorted(r["member"] or "" for r in voted) == ["", "clf_0", "clf_1", "hard vote"]


def test_stored_negatives_are_drawn_to_the_balance(spark):
    p = PredictionParams(balance_ratio=0.5, horizon=Horizon(60, 60))
    codes = spark.createDataFrame([("m", at(i * 1000), 351.0) for i in range(10)] + [("m", at(i * 1000 + 500), 17.0) for i in range(10)], "machine_id string, ts timestamp_ntz, code double")
    stored = spark.createDataFrame([("m", at(i * 1000), 351, "f", 1.0) for i in range(10)] + [("m", at(i * 20 + 1), 17, f, 2.0) for i in range(400) for f in ("f", "g")],
                                   "machine_id string, ts timestamp_ntz, code int, feature string, value double")
    kept = prediction.stored_for_balance(stored, codes, p).collect()
    assert sum(r["code"] == 351 for r in kept) == 10
    assert len({r["ts"] for r in kept if r["code"] != 351}) == 10 and len(kept) == 30


def test_many_categories_stay_a_table(spark):
    """25,000 categories: their names are joined to the windows, never collected or written into a plan."""
    df = spark.range(25_000).select(F.lit("m").alias("machine_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
                                    F.concat(F.lit("s"), "id").alias("state"), F.lit(17.0).alias("code"))
    p = PredictionParams(target_col="code")
    given = prediction.window_input(df, p)
    assert given.names.count() == 25_000
    examples = df.filter("state = 's200'").select("machine_id", "ts", F.lit(351).alias("code"))
    long = prediction.example_features(given, examples, p.horizon)
    assert long.filter("feature like 'state.s%__mean'").count() == 25_000
    assert long.filter("feature like 'state.s%__maximum' AND value = 1").count() == 61


def test_damaged_dumps_are_set_aside(spark, tmp_path):
    stamp = {"timestamp": {"$date": 0}, "sequence": {"$numberLong": "1"}}
    record = lambda v: json.dumps({"machineId": "Integrex", "components": [{"id": "c", "samples": [{"id": "load", "value": v, **stamp}], "conditions": [
        {"id": "l", "errorCode": 5, "message": "worn", "status": "open", **stamp}]}]})
    for name, text in (("a.gz", record(1.0) + record(2.0)), ("b.gz", record(3.0) * 200), ("c.gz", record(4.0) + " trailing")):
        data = gzip.compress(text.encode())
        (tmp_path / name).write_bytes(data[: len(data) // 2] if name == "b.gz" else data)
    samples, bad = prediction.extract(spark, str(tmp_path), "Integrex")
    series = {r["series"]: (r["num_value"], r["str_value"]) for r in samples.collect()}
    assert series["components.c.conditions.l.message"] == (None, "worn") and series["components.c.conditions.l.status"] == (None, "open")
    assert series["components.c.samples.load.value"][0] in (1.0, 2.0)
    assert sorted((r["source_file"].rsplit("/", 1)[1], r["text"] is None) for r in bad.collect()) == [("b.gz", True), ("c.gz", False)]


def test_shared_folder_and_settled_tables(spark, tmp_path, monkeypatch):
    from faultline import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Remote:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_dir(Remote())
    Remote.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.shared_dir(Remote()) == "hdfs://x/y"
    with session.settled_tables():
        df = session.settle(spark.range(5), "five")
        assert df.count() == 5
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert pathlib.Path(path).exists()
    assert not pathlib.Path(path).exists()

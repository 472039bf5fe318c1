"""Readers and stores on small files."""

from __future__ import annotations

import dataclasses
import datetime as dt
import gzip
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from faultline.operators import timeline
from faultline.params import Horizon, MiningParams, PredictionParams, parameter_grid
from faultline.sources import files, raw_json, site_log, stores
from faultline.streaming.ingest import ingest_new_files

T0 = dt.datetime(2024, 1, 1)
MS0 = 1704067200000


def record(machine="Integrex", items=(), ident="c", name="text"):
    samples = [{"id": i, "name": name, "value": v, "timestamp": {"$date": MS0 + t}, "sequence": {"$numberLong": str(s)}} for i, t, s, v in items]
    return json.dumps({"_id": {"$oid": "1"}, "machineId": machine, "components": [{"id": ident, "samples": samples}]})


def dump(path: pathlib.Path, *objects: str) -> str:
    with gzip.open(path, "wt") as f:
        f.write("".join(objects))
    return str(path)


def test_concatenated_file(spark, tmp_path):
    name = r"\x41\\x42"  # the second escape is itself escaped
    text = record(items=[("load", 1500, 1, 2.5)]).replace('"text"', f'"{name}"')
    path = dump(tmp_path / "a.json.gz", text, record(items=[("load", 2000, 2, 3.5)]), record(items=[]))
    good, bad = raw_json.parse_records(raw_json.read_fragments(spark, path))
    assert good.count() == 3 and bad.count() == 0
    items = raw_json.component_items(good).orderBy("seq").collect()
    assert [(r["ts"], r["num_value"], r["seq"]) for r in items] == [(T0 + dt.timedelta(seconds=1), 2.5, 1.0), (T0 + dt.timedelta(seconds=2), 3.5, 2.0)]
    assert items[0]["name"] == "A\\x42"


def test_braces_inside_text_do_not_stop_the_others(spark, tmp_path):
    broken = record(items=[("load", 0, 1, 1.0)], name="a}{b")
    path = dump(tmp_path / "a.json.gz", record(items=[("load", 0, 1, 1.0)]), broken, record(items=[("load", 9000, 3, 1.0)]))
    good, bad = raw_json.parse_records(raw_json.read_fragments(spark, path))
    assert raw_json.component_items(good).count() == 2
    assert bad.count() == 2  # both halves are kept for inspection


def test_split_of_a_text_column_matches_the_file_reader(spark, tmp_path):
    objects = [record(items=[("load", i * 1000, i, float(i))]) for i in range(5)]
    path = dump(tmp_path / "a.json.gz", *objects)
    from_file = raw_json.parse_records(raw_json.read_fragments(spark, path))[0].select("record")
    column = spark.createDataFrame([("".join(objects),)], "text string")
    from_column = raw_json.parse_records(raw_json.split_objects(column, "text"))[0].select("record")
    assert from_file.exceptAll(from_column).isEmpty() and from_file.count() == 5


def test_flatten_names(spark):
    df = spark.createDataFrame([("x",)], "k string").select(
        F.struct(F.col("k").alias("a"), F.array(F.struct(F.lit(1).alias("b"), F.array(F.lit("p"), F.lit("q")).alias("c"))).alias("l"), F.lit(None).cast("int").alias("n")).alias("record"))
    got = {r["field"]: r["value"] for r in raw_json.flatten_record(df).collect()}
    assert got == {"a": "x", "l.0.b": "1", "l.0.c.0": "p", "l.0.c.1": "q"}


def test_flatten_keeps_fields_outside_the_schema(spark):
    text = '{"machineId":"m","shift":{"crew":["a",{"n":2}],"none":null,"empty":{}},"rows":[],"x":1.5,"on":true,"components":[{"id":"c","extra":"e"}]}'
    rows = [(1, text), (2, "no json"), (3, '{"a":1} tail'), (4, "[1]"), (5, None), (6, '{"a":1}}')]
    flat, bad = raw_json.flatten_objects(spark.createDataFrame(rows, "id long, text string"))
    got = {(r["id"], r["field"]): r["value"] for r in flat.collect()}
    assert got == {(1, "machineId"): "m", (1, "shift.crew.0"): "a", (1, "shift.crew.1.n"): "2", (1, "shift.none"): None, (1, "shift.empty"): "{}", (1, "rows"): "[]",
                   (1, "x"): "1.5", (1, "on"): "true", (1, "components.0.id"): "c", (1, "components.0.extra"): "e", (6, "a"): "1"}
    assert sorted(r["id"] for r in bad.collect()) == [2, 3, 4, 5]


def test_series_names(spark, tmp_path):
    path = dump(tmp_path / "a.json.gz", record(items=[("load", 0, 1, 1.0), (None, 0, 1, 1.0)], ident="spindle"), record(items=[("load", 0, 1, 1.0)], ident=None))
    items = raw_json.component_items(raw_json.parse_records(raw_json.read_fragments(spark, path))[0])
    assert [r["series"] for r in raw_json.item_samples(items).collect()] == ["components.spindle.samples.load.value"]


def test_lost_columns_raise(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert raw_json.join_side_by_side([a, a, a], ["k"], 4).columns == ["k", "v", "v_1", "v_2"]
    with pytest.raises(ValueError):
        raw_json.join_side_by_side([a, a], ["k"], 5)


def test_selection_by_stem(spark):
    raw = spark.createDataFrame([("/r/2019-01.json.gz",), ("/r/2019-02.json.gz",), ("C:\\r\\2019-03.json.gz",)], "path string")
    done = spark.createDataFrame([("/b/2019-01.parquet.gzip",), ("/b/2019-03.parquet.gzip",)], "path string")
    assert [r[0] for r in files.unprocessed(raw, done).collect()] == ["/r/2019-02.json.gz"]


def test_listing(spark, tmp_path):
    dump(tmp_path / "a.json.gz", "{}")
    dump(tmp_path / "b.json.gz", "{}")
    assert files.list_files(spark, f"{tmp_path}/*.gz").count() == 2


def test_common_columns(spark, tmp_path):
    spark.range(3).selectExpr("id AS k", "id AS b", "id AS a").write.parquet(f"{tmp_path}/x")
    spark.range(2).selectExpr("id AS k", "id AS a", "id AS c").write.parquet(f"{tmp_path}/y")
    df = files.read_common(spark, [f"{tmp_path}/x", f"{tmp_path}/y"])
    assert df.columns == ["a", "k"] and df.count() == 5


def test_sampled_files_repeat(spark):
    listed = spark.createDataFrame([(f"f{i}",) for i in range(50)], "path string")
    first = {r[0] for r in files.sample_files(listed, 7, 1).collect()}
    assert len(first) == 7 and first == {r[0] for r in files.sample_files(listed.repartition(5), 7, 1).collect()}
    assert first != {r[0] for r in files.sample_files(listed, 7, 2).collect()}


def test_duplicate_sensor_entries_raise(spark):
    df = spark.createDataFrame([(T0, "a", 1.0), (T0, "a", 2.0)], "timestamp timestamp_ntz, sensor string, gesamtwirkleistung double")
    with pytest.raises(ValueError):
        site_log.pivot_sensors(df)


def test_sensor_query_keeps_largest_of_repeated_entries(spark, tmp_path):
    from catalog.sources import sensor_log_pivoted
    rows = [(1, T0, 1, "click", 1.0, None), (2, T0, 2, "click", 3.0, None), (3, T0, 2, "view", 2.0, None), (4, T0 + dt.timedelta(seconds=1), 1, "view", None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["global_timestamp"]: (r["click_samples"], r["view_samples"]) for r in sensor_log_pivoted(spark, str(tmp_path)).collect()}
    assert got == {T0: (3.0, 2.0), T0 + dt.timedelta(seconds=1): (None, None)}


def test_site_log_text_times(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "7", 1, None), ("2024-01-01 10:00:00", "7", 2, None)], "time string, errorcode string, main_id int, note string")
    rows = site_log.clean_site_log(df).collect()
    assert len(rows) == 1 and rows[0]["errorCode"] == 7 and rows[0]["global_timestamp"] == dt.datetime(2024, 1, 1, 10)


def test_machine_ids_are_checked(spark):
    df = spark.createDataFrame([("Integrex",)], "machineId string")
    assert timeline.single_machine(df, "Integrex").count() == 1
    assert timeline.single_machine(df, "VTC530C").count() == 0
    with pytest.raises(ValueError):
        timeline.single_machine(df, "other")


def test_name_groups(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "`machineId` int, `c.x.name` int, `c.x.state` int, `c.x.value` int, `c.x.message` int")
    assert timeline.drop_named(df).columns == ["c.x.state", "c.x.value", "c.x.message"]
    assert timeline.drop_named(df, ["state", "message"]).columns == ["machineId", "c.x.name", "c.x.value"]


def test_attached_series_needs_its_local_columns(spark):
    line = spark.createDataFrame([(1,)], "ts int")
    with pytest.raises(ValueError):
        timeline.attach_series(line, line, ["ts"], ["seq"])


def test_sequence_ties(spark):
    rows = [("m", "s", 1, "2", 0, "old"), ("m", "s", 1, "10", 1, "high"), ("m", "s", 1, "10", 2, "later"), ("m", "s", 2, "1", 3, "single")]
    df = spark.createDataFrame(rows, "machine_id string, series string, ts int, seq string, row int, v string")
    got = timeline.latest_wins(df, tie=["row"]).orderBy("ts").collect()
    assert [r["v"] for r in got] == ["later", "single"]  # 10 > 2 as numbers


def test_stage_store_runs_once(spark, tmp_path):
    calls = []
    store = stores.StageStore(spark, str(tmp_path))

    def build():
        calls.append(1)
        return spark.range(3)

    first, key = store.create_or_load("s", build, ["in"], horizon=Horizon(1, 2))
    second, same = store.create_or_load("s", build, ["in"], horizon=Horizon(1, 2))
    assert key == same and len(calls) == 1 and first.count() == second.count() == 3
    store.create_or_load("s", build, ["in"], horizon=Horizon(1, 3))
    store.create_or_load("s", build, ["other"], horizon=Horizon(1, 2))
    assert len(calls) == 3


def test_partly_written_stage_is_rebuilt(spark, tmp_path):
    store = stores.StageStore(spark, str(tmp_path))
    key = store.key("s", [])
    (tmp_path / "stage=s" / f"key={key}").mkdir(parents=True)
    df, _ = store.create_or_load("s", lambda: spark.range(2))
    assert df.count() == 2


def test_example_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert stores.stored_examples(spark, path, 351, Horizon(), True) is None
    df = spark.createDataFrame([("m", T0, 1.0)], "machine_id string, ts timestamp_ntz, f double")
    stores.append_examples(df, path, 351, Horizon(1, 2), True)
    stores.append_examples(df, path, 351, Horizon(1, 3), True)
    stores.append_examples(df, path, 351, Horizon(1, 2), False)
    held = stores.stored_examples(spark, path, 351, Horizon(1, 2), True)
    assert held.columns == df.columns and held.count() == 1
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "errorcode" in plan


def test_results_are_appended(spark, tmp_path):
    path = f"{tmp_path}/results"
    summary = spark.createDataFrame([(1, 0.5)], "seed int, accuracy_mean double")
    stores.append_results(summary, path, classifier="logistic", folds=5)
    stores.append_results(summary, path, classifier="svm_linear", folds=5)
    assert {r["classifier"] for r in spark.read.parquet(path).collect()} == {"logistic", "svm_linear"}


def test_mining_tables(spark, tmp_path):
    stores.write_mining(str(tmp_path), MiningParams(), spark.range(2), spark.range(3))
    assert [spark.read.parquet(f"{tmp_path}/{t}").count() for t in ("config", "fq_itemsets", "asc_rules")] == [1, 2, 3]


def test_stream_takes_new_files_only(spark, tmp_path):
    raw, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    raw.mkdir()
    dump(raw / "a.json.gz", record(items=[("load", 0, 1, 1.0)]), '{"broken":')
    ingest_new_files(spark, str(raw), out, state)
    assert spark.read.parquet(f"{out}/samples").count() == 1
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
    dump(raw / "b.json.gz", record(items=[("load", 1000, 1, 1.0), ("load", 2000, 2, 1.0)]))
    ingest_new_files(spark, str(raw), out, state)
    assert spark.read.parquet(f"{out}/samples").count() == 3


def test_parameter_grid():
    runs = list(parameter_grid({"target_code": [1, 2], "classifier": ["logistic", "svm_rbf", "svm_linear"]}))
    assert len(runs) == 6 and len(set(runs)) == 6
    assert runs[0] == dataclasses.replace(PredictionParams(), target_code=1, classifier="logistic")
    with pytest.raises(ValueError):
        list(parameter_grid({"no_such": [1]}))

"""S1-S15 and R1-R3 on data derived from the benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import LOG_SQL, PLANT, TARGET, log, query, table
from catalog.labels import HOUR, SEED, draw_sql, kept_sql, positives
from faultline.functions.times import epoch_us
from faultline.operators import resample
from faultline.sources import dumps, files, raw_json, site_log, stores
from faultline.session import shared_dir


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT DISTINCT 'raw/' || strftime(ts, '%Y-%m-%d') || '_' || user_id || '.json.gz' AS path FROM events
WHERE strftime(ts, '%Y-%m-%d') || '_' || user_id NOT IN (SELECT strftime(ts, '%Y-%m-%d') || '_' || user_id FROM events WHERE event_type = 'error')""")
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw file per user and day; those with an error are already in the buffer."""
    rows = table(spark, sf_dir, "events").withColumn("name", F.concat_ws("_", F.to_date("ts").cast("string"), "user_id"))
    raw = rows.select(F.concat(F.lit("raw/"), "name", F.lit(".json.gz")).alias("path")).distinct()
    done = rows.filter("event_type = 'error'").select(F.concat(F.lit("buffer/"), "name", F.lit(".parquet.gzip")).alias("path"))
    return files.unprocessed(raw, done)


@query("""SELECT event_id, 0 AS position, event_id AS id, 'A' || event_type || '{}' AS name FROM events
UNION ALL SELECT event_id, 1, user_id, 'v\\x' || event_type FROM events""")
def split_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Two objects in one text; a \x escape to repair, one that is itself escaped, braces inside text."""
    text = F.format_string('{"id":%d,"name":"\\x41%s{}"}{"id":%d,"name":"v\\\\x%s"}', "event_id", "event_type", "user_id", "event_type")
    parts = raw_json.split_objects(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    good, _ = raw_json.parse_records(parts, schema="id bigint, name string")
    return good.select("event_id", "position", "record.id", "record.name")


@query("SELECT event_id, 'missing brace' AS reason FROM events WHERE event_id % 10 = 3 UNION ALL SELECT event_id, 'no json' FROM events WHERE event_id % 10 = 5")
def quarantined_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken objects are set aside, all others are read."""
    text = (F.when(F.col("event_id") % 10 == 3, F.format_string('{"id":%d', "event_id"))
            .when(F.col("event_id") % 10 == 5, F.lit("no json")).otherwise(F.format_string('{"id":%d}', "event_id")))
    good, bad = raw_json.parse_records(table(spark, sf_dir, "events").select("event_id", text.alias("text")), schema="id bigint")
    stray = good.filter("record.id <> event_id").select("event_id", F.lit("misread").alias("reason"))
    reason = F.when(F.col("text").startswith("{"), "missing brace").otherwise("no json")
    return bad.select("event_id", reason.alias("reason")).unionByName(stray)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, 'order.key' AS field, CAST(l_orderkey AS VARCHAR) AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'order.lines.' || i || '.part.id', CAST(l_partkey AS VARCHAR) FROM l
UNION ALL SELECT l_orderkey, 'order.lines.' || i || '.flag', l_returnflag FROM l""")
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with its lines as one nested record (a few lines each), flattened with list positions in the names."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    lines = F.transform("lines", lambda x: F.struct(F.struct(x["l_partkey"].alias("id")).alias("part"), x["l_returnflag"].alias("flag")))
    record = F.struct(F.struct(F.col("l_orderkey").alias("key"), lines.alias("lines")).alias("order"))
    return raw_json.flatten_record(nested.select("l_orderkey", record.alias("record")))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, 'order.key' AS field, CAST(l_orderkey AS VARCHAR) AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'order.lines.' || i || '.part.id', CAST(l_partkey AS VARCHAR) FROM l
UNION ALL SELECT l_orderkey, 'order.lines.' || i || '.flag', l_returnflag FROM l""")
def flattened_open_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders as JSON text, flattened without a schema."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    lines = F.transform("lines", lambda x: F.struct(F.struct(x["l_partkey"].alias("id")).alias("part"), x["l_returnflag"].alias("flag")))
    record = F.struct(F.struct(F.col("l_orderkey").alias("key"), lines.alias("lines")).alias("order"))
    return raw_json.flatten_objects(nested.select("l_orderkey", F.to_json(record).alias("text")))[0]


@query("SELECT event_id, date_trunc('second', ts) AS event_timestamp, epoch_us(ts) // 1000 AS ms FROM events")
def epoch_ms_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(epoch_us(F.col("ts")) / 1000)
    return raw_json.convert_timestamps(table(spark, sf_dir, "events").select("event_id", ms.alias("event_timestamp"), ms.alias("ms")))


@query("""WITH s AS (SELECT 'Integrex' AS machine_id, user_id, date_trunc('second', ts) AS ts, CAST(event_id AS DOUBLE) AS seq, event_type, value FROM events)
SELECT machine_id, 'components.u' || user_id || '.samples.load.value' AS series, ts, seq, value AS num_value, NULL::VARCHAR AS str_value FROM s
UNION ALL SELECT machine_id, 'components.u' || user_id || '.events.mode.state', ts, seq, NULL, event_type FROM s
UNION ALL SELECT machine_id, 'components.u' || user_id || '.conditions.logic.errorCode', ts, seq, 351.0, NULL FROM s WHERE event_type = 'error'""")
def raw_records_to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole path: concatenated JSON text -> records -> components and items named by id -> samples."""
    rows = table(spark, sf_dir, "events")
    stamp = F.format_string('"timestamp":{"$date":%d},"sequence":{"$numberLong":"%d"}', F.floor(epoch_us(F.col("ts")) / 1000), F.col("event_id"))
    head = F.format_string('{"_id":{"$oid":"%d"},"className":"m","machineId":"Integrex","components":[', "event_id")
    samples = F.concat(
        head, F.format_string('{"id":"u%d","samples":[{"id":"load","value":', "user_id"), F.col("value").cast("string"), F.lit(","), stamp,
        F.lit('},{"id":null,"value":1}]},{"id":null,"samples":[{"id":"lost","value":1}]}]}'))
    states = F.concat(
        head, F.format_string('{"id":"u%d","events":[{"id":"mode","state":"%s",', "user_id", "event_type"), stamp, F.lit("}]"),
        F.when(F.col("event_type") == "error", F.concat(F.lit(',"conditions":[{"id":"logic","errorCode":351,'), stamp, F.lit("}]"))).otherwise(""),
        F.lit("}]}"))
    objects = raw_json.split_objects(rows.select(F.concat(samples, states).alias("text")), "text")
    records, _ = raw_json.parse_records(objects.drop("position"))
    return raw_json.item_samples(raw_json.component_items(records))


@query("""WITH a AS (SELECT user_id, max(value) AS level FROM events GROUP BY 1), b AS (SELECT user_id, min(value) AS level, count(*) AS n FROM events GROUP BY 1)
SELECT a.user_id, a.level, b.level AS level_1, b.n FROM a JOIN b ON b.user_id = a.user_id""")
def parts_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with equal column names next to each other, names numbered."""
    rows = table(spark, sf_dir, "events").groupBy("user_id")
    a, b = rows.agg(F.max("value").alias("level")), rows.agg(F.min("value").alias("level"), F.count(F.lit(1)).alias("n"))
    return raw_json.join_side_by_side([a, b], ["user_id"], expected=4)


@query(f"WITH {LOG_SQL} SELECT ts AS global_timestamp, CAST(code AS INT) AS \"errorCode\", CAST(user_id AS VARCHAR) AS user_id, event_type FROM log")
def site_log_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry was exported twice under different row numbers."""
    once = log(spark, sf_dir).select(F.col("ts").alias("time"), F.col("code").alias("errorcode"), F.col("event_id").alias("main_id"),
                                     F.col("machine_id").alias("user_id"), "event_type")
    return site_log.unify_site_log(once.unionByName(once.withColumn("main_id", -F.col("main_id") - 1)), False)


@query("SELECT ts AS global_timestamp, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}_samples" for t in ("click", "error", "purchase", "signup", "view"))
       + " FROM events GROUP BY ts")
def sensor_log_pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("sensor"), F.col("value").alias("gesamtwirkleistung"))
    wide = site_log.pivot_sensors(rows, duplicates="max")  # the SQL keeps the largest of repeated (ts, event_type) entries
    return wide.toDF(*[c.replace(".", "_") for c in wide.columns])


@query("SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def common_columns_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files with different schemas: only what both have is read."""
    return files.read_common(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"])


@query(f"""SELECT path FROM (SELECT DISTINCT 'raw/' || user_id || '.gz' AS path FROM events) ORDER BY {draw_sql(SEED, "path")}, path LIMIT 20""")
def sampled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select(F.concat(F.lit("raw/"), F.col("user_id").cast("string"), F.lit(".gz")).alias("path")).distinct()
    return files.sample_files(paths, 20, SEED)


@query("SELECT strftime(ts, '%Y-%m-%d') AS source_file, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def buffer_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory per source file, read back."""
    path = _scratch(spark, "buffer")
    rows = table(spark, sf_dir, "events").withColumn("source_file", F.date_format("ts", "yyyy-MM-dd"))
    files.write_buffer(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id AS machine_id, count(*) AS bins FROM (SELECT user_id, unnest(generate_series(min(epoch_us(ts) // 3600000000), max(epoch_us(ts) // 3600000000))) FROM events GROUP BY 1) GROUP BY 1")
def stage_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage is built once; the second request with equal parameters reads the stored table."""
    store = stores.StageStore(spark, _scratch(spark, "stages"))
    rows = log(spark, sf_dir)

    def build() -> DataFrame:
        return resample.resample_last(rows, 3600, ["value"])

    def again() -> DataFrame:
        raise AssertionError("the stage is stored already")

    _, first = store.create_or_load("resampled", build, [sf_dir], seconds=3600)
    table_, second = store.create_or_load("resampled", again, [sf_dir], seconds=3600)
    assert first == second
    return table_.groupBy("machine_id").agg(F.count(F.lit(1)).alias("bins"))


@query(f"WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)} SELECT '{PLANT}' AS machine_id, make_timestamp(us) AS ts FROM kept")
def example_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives appended to the store; the positives of one horizon read back."""
    path = _scratch(spark, "examples")
    found = positives(spark, sf_dir)
    stores.append_examples(found, path, TARGET, HOUR, True)
    stores.append_examples(found.filter("ts < timestamp_ntz'2024-01-15'"), path, TARGET, HOUR, False)
    return stores.processed_timestamps(stores.stored_examples(spark, path, TARGET, HOUR, True))


@query("""WITH e AS (SELECT event_id, event_type, CAST(value AS VARCHAR) AS v, value FROM events)
SELECT event_id, 'components.c.conditions.logic.errorCode' AS series, CAST(event_id AS DOUBLE) AS num_value, NULL AS str_value FROM e
UNION ALL SELECT event_id, 'components.c.conditions.logic.message', NULL, 'code ' || event_type FROM e
UNION ALL SELECT event_id, 'components.c.conditions.logic.status', NULL, event_type FROM e WHERE event_type <> 'view'
UNION ALL SELECT event_id, 'components.c.events.mode.state', NULL, event_type FROM e
UNION ALL SELECT event_id, 'components.c.samples.load.value', value, NULL FROM e""")
def item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept field of an item is a series: value, state, code, message and status (null for one type)."""
    stamp = F.format_string('"timestamp":{"$date":0},"sequence":{"$numberLong":"%d"}', "event_id")
    status = F.when(F.col("event_type") == "view", F.lit("null")).otherwise(F.format_string('"%s"', "event_type"))
    text = F.concat(
        F.lit('{"machineId":"m","components":[{"id":"c","samples":[{"id":"load","value":'), F.col("value").cast("string"), F.lit(","), stamp,
        F.lit('}],"events":[{"id":"mode","state":"'), F.col("event_type"), F.lit('",'), stamp,
        F.lit('}],"conditions":[{"id":"logic","errorCode":'), F.col("event_id").cast("string"), F.lit(',"message":"code '), F.col("event_type"),
        F.lit('","status":'), status, F.lit(","), stamp, F.lit("}]}]}"))
    records, _ = raw_json.parse_records(table(spark, sf_dir, "events").select("event_id", text.alias("text")))
    samples = raw_json.field_samples(raw_json.component_items(records, keep=["event_id"]), keep=["event_id"])
    return samples.select("event_id", "series", "num_value", "str_value")


@query("SELECT event_id, event_id % 4 IN (1, 2) AS set_aside FROM events")
def trailing_text_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text or another object after an object's end makes it unusable; braces within strings don't matter."""
    n = F.col("event_id") % 4
    text = (F.when(n == 1, F.format_string('{"id":%d} trailing {junk', "event_id")).when(n == 2, F.format_string('{"id":%d} {"id":1}', "event_id"))
            .when(n == 3, F.format_string('{"id":%d,"name":"a} b \\"} c"}', "event_id")).otherwise(F.format_string('{"id":%d}}', "event_id")))
    good, bad = raw_json.parse_records(table(spark, sf_dir, "events").select("event_id", text.alias("text")), schema="id bigint, name string")
    return good.select("event_id", F.lit(False).alias("set_aside")).unionByName(bad.select("event_id", F.lit(True).alias("set_aside")))


@query("""SELECT event_id, event_id % 8 IN (1, 2, 3, 4, 6) AS set_aside FROM events""")
def outermost_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma, a bracket or a second object behind the outermost brace sets a text aside; one brace too many and blanks don't."""
    n, object_ = F.col("event_id") % 8, F.format_string('{"id":%d,"in":[{"name":"}, {"},{"a":{}}]}', "event_id")
    text = (F.when(n == 1, F.concat(object_, F.lit(',{"id":2}'))).when(n == 2, F.concat(object_, F.lit('] junk {"id":4}')))
            .when(n == 3, F.concat(object_, F.lit(", junk"))).when(n == 4, F.concat(object_, F.lit('],[{"id":8}')))
            .when(n == 5, F.concat(F.lit(" "), object_, F.lit("}\n"))).when(n == 6, F.concat(object_, F.lit("}}"))).otherwise(object_))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    good, bad = raw_json.parse_records(rows, schema="id bigint, `in` array<struct<name: string>>")
    return good.select("event_id", F.lit(False).alias("set_aside")).unionByName(bad.select("event_id", F.lit(True).alias("set_aside")))


@query(f"""WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS path, event_id, user_id % 4 AS kind,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS i,
  count(*) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')) AS n FROM events)
SELECT path, CASE WHEN kind <> 3 OR event_id % 5 <> 0 THEN event_id END AS id, CASE WHEN kind = 3 AND event_id % 5 = 0 THEN '{dumps.UNFINISHED}' END AS problem
FROM e WHERE kind <> 1 OR i < 3
UNION ALL SELECT path, NULL, 'damaged' FROM e WHERE kind = 1 AND i = 3
UNION ALL SELECT path, NULL, '{dumps.OUTSIDE}' FROM e WHERE kind = 2""")
def damaged_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip file of one member an object for every user and day; of four users one has files that are damaged from the third member
    on, one has commas between its objects and text at the end, and one has objects without their last brace."""
    def packed(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            contents = []
            for kind, ids in zip(batch.column("kind").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                texts = [f'{{"id":{i},"name":"}}{{ \\" {i}"' + ("" if kind == 3 and i % 5 == 0 else "}") for i in ids]
                if kind == 2:
                    texts = [t + "," for t in texts[:-1]] + [texts[-1] + " tail"]
                members = [gzip.compress(t.encode()) for t in texts]
                contents.append(b"".join(members[:2] + ([b"\x1f\x8b" + bytes(40)] + members[3:] if kind == 1 and len(members) > 2 else members[2:])))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"])

    day = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    listed = (table(spark, sf_dir, "events").groupBy(day.alias("path"), (F.col("user_id") % 4).alias("kind"))
              .agg(F.sort_array(F.collect_list("event_id")).alias("ids")))  # a user's day
    rows = dumps.cut_files(listed.mapInArrow(packed, "path string, content binary"), strict=False)
    number = F.when(F.col("problem").isNull(), F.get_json_object("text", "$.id").cast("bigint"))
    return rows.select(F.col("source_file").alias("path"), number.alias("id"), F.when(F.col("problem").isNotNull() & F.col("text").isNull(), "damaged").otherwise(F.col("problem")).alias("problem"))


@query("SELECT event_id AS id, event_type || '}{' AS name FROM events")
def dump_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written to compressed files, with joints within strings and commas between some objects, and read back."""
    path = _scratch(spark, "dumps")
    rows = table(spark, sf_dir, "events")
    text = F.concat(F.format_string('{"id":%d,"name":"%s}{"}', "event_id", "event_type"), F.when(F.col("event_id") % 3 == 0, ",").otherwise(""))
    rows.select(text.alias("text")).repartition(8, "text").write.option("compression", "gzip").text(path)
    good, _ = raw_json.parse_records(dumps.read_dumps(spark, path, strict=False).filter("problem IS NULL"), schema="id bigint, name string", cut=True)
    return good.select("record.id", "record.name")


@query("""WITH e AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS n FROM events)
SELECT event_id, 'event.' || event_type || '.user' AS field, CAST(user_id AS VARCHAR) AS value FROM e
UNION ALL SELECT event_id, 'event.' || event_type || '.at.0.k' || event_id % 5, event_type FROM e
UNION ALL SELECT event_id, 'event.' || event_type || '.at.1', NULL FROM e
UNION ALL SELECT event_id, 'on', 'true' FROM e WHERE n IS NOT NULL
UNION ALL SELECT event_id, 'none', '{}' FROM e WHERE n IS NULL""")
def flattened_varied_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose keys differ from row to row, flattened without a schema."""
    text = F.concat(F.format_string('{"event":{"%s":{"user":%d,"at":[{"k%d":"%s"},null]}},', "event_type", "user_id", F.col("event_id") % 5, "event_type"),
                    F.when(F.col("event_id") % 3 == 0, '"on":true}').otherwise('"none":{}}'))
    return raw_json.flatten_objects(table(spark, sf_dir, "events").select("event_id", text.alias("text")))[0]

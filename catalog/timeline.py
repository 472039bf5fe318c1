"""R4-R13 on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import PLANT, TYPES, WIDE_SQL, log, query, table, wide
from faultline.operators import fill, timeline
from faultline.sources.raw_json import flatten_record, parse_records

MINUTE = "date_trunc('minute', ts)"


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir, PLANT)
    return rows.select("machine_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"),
                       F.col("event_type").alias("series"), F.col("event_id").alias("seq"), "value")


@query(f"SELECT event_id, ts, value FROM events WHERE user_id = 8")
def single_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return timeline.single_machine(rows, 8, "user_id", range(0, 1_000_000)).select("event_id", "ts", "value")


@query("""
SELECT f.field, count(*) AS n FROM orders CROSS JOIN (VALUES
  ('components.0.id'), ('components.0.samples.0.id'), ('components.0.samples.0.value'),
  ('components.0.samples.0.timestamp.$date'), ('components.0.samples.0.sequence.$numberLong')) f(field)
GROUP BY f.field""")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened raw records of orders without device, name and type fields."""
    orders = table(spark, sf_dir, "orders")
    text = orders.select(F.format_string(
        '{"_id":{"$oid":"%d"},"className":"log","machineId":"Integrex","components":[{"id":"c","name":"spindle",'
        '"componentType":"axis","samples":[{"id":"load","name":"load","type":"LOAD","subType":"ACTUAL","value":%d,'
        '"timestamp":{"$date":%d},"sequence":{"$numberLong":"%d"}}]}]}',
        "o_orderkey", "o_custkey", "o_orderkey", "o_orderkey").alias("text"))
    good, _ = parse_records(text)
    kept = timeline.drop_named_fields(flatten_record(good))
    return kept.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, NULL::DOUBLE AS tax FROM lineitem WHERE l_linenumber % 2 = 1 AND l_quantity <> 7
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, NULL, l_tax FROM lineitem WHERE l_linenumber % 2 = 0""")
def stacked_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    odd = lines.filter("l_linenumber % 2 = 1").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "nullif(l_quantity, 7) AS quantity")
    even = lines.filter("l_linenumber % 2 = 0").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_tax AS tax")
    return timeline.stack_repeats([odd, even], ["quantity", "tax"])


@query("""
SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipdate
    ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return timeline.latest_wins(lines, ["l_orderkey", "l_shipdate"], "l_linenumber", ["l_partkey", "l_suppkey", "l_quantity"])


@query(f"SELECT DISTINCT user_id AS machine_id, {MINUTE} AS ts FROM events")
def global_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return timeline.timeline(rows)


_LATEST_MINUTE = f"""last_in_minute AS (
  SELECT {MINUTE} AS minute, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_LATEST_MINUTE}
SELECT '{PLANT}' AS machine_id, minute AS ts, """ + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in TYPES)
       + " FROM last_in_minute GROUP BY minute")
def series_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest record per series and minute, all series on one timeline."""
    return timeline.widen(timeline.latest_wins(minutes(spark, sf_dir)), "value")


@query(f"""WITH line AS (SELECT DISTINCT {MINUTE} AS ts FROM events), {_LATEST_MINUTE}
SELECT '{PLANT}' AS machine_id, line.ts, e.value AS error_value FROM line LEFT JOIN last_in_minute e ON e.minute = line.ts AND e.event_type = 'error'""")
def series_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minutes(spark, sf_dir)
    errors = timeline.latest_wins(rows).filter("series = 'error'").withColumn("local_ts", F.col("ts"))
    local = errors.select("machine_id", "ts", "local_ts", "seq", F.col("value").alias("error_value"))
    return timeline.attach_series(timeline.timeline(rows), local, ["machine_id", "ts"], ["local_ts", "seq"])


@query(f"""WITH {WIDE_SQL}, s AS (SELECT user_id, min(ts) FILTER (error IS NOT NULL OR purchase IS NOT NULL) AS t0 FROM wide GROUP BY 1)
SELECT w.user_id AS machine_id, w.ts, w.error, w.purchase FROM wide w JOIN s ON s.user_id = w.user_id AND w.ts >= s.t0""")
def trimmed_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir, None).select("machine_id", "ts", "error", "purchase")
    return fill.trim_start(rows, ["error", "purchase"])


@query(f"""SELECT user_id AS machine_id, date_trunc('hour', ts) AS ts, min(event_id) AS event_id, arg_min(value, event_id) AS value
FROM events GROUP BY 1, 2""")
def first_row_per_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("machine_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return timeline.first_per_timestamp(rows, ["event_id"])


@query("""SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'nan') AS kind,
  CASE WHEN value > 100 THEN 'true' ELSE 'false' END AS high, value FROM events""")
def objects_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "nullif(event_type, 'view') AS kind", "value > 100 AS high", "value")
    return timeline.objects_to_text(rows, string_nulls="literal")



"""C1-C18 on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import LOG_SQL, PLANT, TYPES, WIDE_SQL, log, query, r6, sql_r6, table, wide
from faultline.operators import cleansing, encode, fill, resample
from faultline.params import EXTREME_MARKER

_FLAGGED = ["all_null", "one_value", "one_and_unavailable", "two_values", "empty_text", "event_type"]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with columns of every kind of emptiness."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "nullif(event_type, event_type) AS all_null", "cast(year(ts) AS string) AS one_value",
        "if(event_type = 'error', 'Unavailable', 'READY') AS one_and_unavailable",
        "if(event_type = 'error', 'STOPPED', 'READY') AS two_values",
        "if(event_type = 'error', '', null) AS empty_text", "event_type")


_FLAGGED_SQL = """flagged AS (SELECT event_id, NULL::VARCHAR AS all_null, CAST(year(ts) AS VARCHAR) AS one_value,
  CASE WHEN event_type = 'error' THEN 'Unavailable' ELSE 'READY' END AS one_and_unavailable,
  CASE WHEN event_type = 'error' THEN 'STOPPED' ELSE 'READY' END AS two_values,
  NULL::VARCHAR AS empty_text, event_type FROM events)"""


@query("""SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind,
  CASE WHEN event_type <> 'click' THEN value END AS value FROM events""")
def missing_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'' and NaN become null; rows with neither kind nor value would fall out."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "if(event_type = 'view', '', event_type) AS kind", "if(event_type = 'click', double('nan'), value) AS value")
    return fill.normalise_missing(rows, ["event_id"])


@query("""SELECT DISTINCT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem
UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem
UNION ALL SELECT DISTINCT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem""")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleansing.distinct_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"])


@query("WITH " + _FLAGGED_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (count(DISTINCT {c}) <= 1 OR (count(DISTINCT {c}) = 2 AND bool_or(upper({c}) = 'UNAVAILABLE'))) AS dropped FROM flagged"""
    for c in _FLAGGED) + ")")
def constant_column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill.normalise_missing(flagged(spark, sf_dir), ["event_id"])
    gone = cleansing.constant_columns(rows, _FLAGGED)
    return spark.createDataFrame([(c, c in gone) for c in _FLAGGED], "column string, dropped boolean")


@query("WITH " + _FLAGGED_SQL + " SELECT event_id, two_values, event_type FROM flagged")
def constant_columns_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleansing.drop_constant_columns(fill.normalise_missing(flagged(spark, sf_dir), ["event_id"]), keep=["event_id"])


def _resampled_sql(seconds: int, origin: str) -> str:
    step = seconds * 1_000_000
    values = ", ".join(f"arg_max({t}, ts) FILTER ({t} IS NOT NULL) AS {t}" for t in TYPES)
    return f"""WITH {WIDE_SQL}, o AS (SELECT {origin} AS o FROM events),
binned AS (SELECT w.*, ((epoch_us(ts) - o.o) // {step}) AS b FROM wide w, o),
per_bin AS (SELECT b, {values} FROM binned GROUP BY b),
grid AS (SELECT unnest(generate_series((SELECT min(b) FROM binned), (SELECT max(b) FROM binned))) AS b)
SELECT '{PLANT}' AS machine_id, make_timestamp(o.o + grid.b * {step}) AS ts, {", ".join("p." + t for t in TYPES)}
FROM grid CROSS JOIN o LEFT JOIN per_bin p ON p.b = grid.b - 1"""


@query(_resampled_sql(600, "CAST(min(0) AS BIGINT)"))
def resampled_600s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_last(wide(spark, sf_dir), 600, TYPES)


@query(_resampled_sql(700, "epoch_us(date_trunc('day', min(ts)))"))
def resampled_700s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A width that does not divide the day: bins count from midnight of the first day."""
    return resample.resample_last(wide(spark, sf_dir), 700, TYPES)


@query(f"""WITH {LOG_SQL}, b AS (SELECT user_id, epoch_us(ts) // 3600000000 AS b, arg_max(value, ts) AS value FROM log GROUP BY 1, 2),
r AS (SELECT user_id, min(b) AS lo, max(b) AS hi FROM b GROUP BY 1),
grid AS (SELECT user_id, unnest(generate_series(lo, hi)) AS b FROM r)
SELECT g.user_id AS machine_id, make_timestamp(g.b * 3600000000) AS ts, b.value FROM grid g LEFT JOIN b ON b.user_id = g.user_id AND b.b = g.b - 1""")
def resampled_per_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_last(log(spark, sf_dir), 3600, ["value"])


@query(f"""WITH g AS (SELECT make_timestamp(t) AS ts FROM (SELECT unnest(generate_series(epoch_us(min(ts)), epoch_us(max(ts)), 600000000)) AS t FROM events)),
j AS (SELECT g.ts AS ts, e.event_type, e.value, row_number() OVER (PARTITION BY g.ts ORDER BY e.ts DESC) AS rn
      FROM g ASOF JOIN events e ON g.ts >= e.ts)
SELECT '{PLANT}' AS machine_id, ts, {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in TYPES)} FROM j WHERE rn = 1""")
def resampled_asof_600s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest whole row at or before each grid point, nulls included."""
    return resample.resample_asof(wide(spark, sf_dir), 600, TYPES)


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS value FROM events")
def extreme_marker_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "click", F.lit(EXTREME_MARKER)).otherwise(F.col("value")).alias("value"))
    return fill.replace_extreme(rows, ["value"])


@query(f"""WITH {WIDE_SQL} SELECT '{PLANT}' AS machine_id, ts, event_id, {", ".join(
    f"last_value({t} IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS {t}" for t in TYPES)} FROM wide""")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are one machine: the two-level scan spreads them over time slots."""
    return fill.forward_fill(wide(spark, sf_dir), TYPES, tie=["event_id"])


@query(f"""WITH {WIDE_SQL} SELECT user_id AS machine_id, ts, event_id, {", ".join(
    f"last_value({t} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {t}" for t in TYPES)} FROM wide""")
def forward_filled_limit_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.forward_fill(wide(spark, sf_dir, None), TYPES, tie=["event_id"], limit=2)


def _interpolated_sql(x: str) -> str:
    look = "OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)", "OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for t in TYPES:
        parts.append(f"last_value({t} IGNORE NULLS) {look[0]} AS {t}_a, last_value(CASE WHEN {t} IS NOT NULL THEN x END IGNORE NULLS) {look[0]} AS {t}_xa, "
                     f"first_value({t} IGNORE NULLS) {look[1]} AS {t}_b, first_value(CASE WHEN {t} IS NOT NULL THEN x END IGNORE NULLS) {look[1]} AS {t}_xb")
    shown = ", ".join(
        f"CASE WHEN {t} IS NOT NULL THEN {sql_r6(t)} WHEN {t}_b IS NULL THEN {sql_r6(t + '_a')} "
        f"ELSE {sql_r6(f'{t}_a + ({t}_b - {t}_a) * (x - {t}_xa) / ({t}_xb - {t}_xa)')} END AS {t}" for t in TYPES)
    return f"""WITH {WIDE_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS p FROM wide), nx AS (SELECT *, CAST({x} AS DOUBLE) AS x FROM n),
l AS (SELECT *, {", ".join(parts)} FROM nx) SELECT event_id, {shown} FROM l"""


def _interpolated(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    done = fill.interpolate(wide(spark, sf_dir), TYPES, method, tie=["event_id"])
    return done.select("event_id", *[r6(F.col(t)).alias(t) for t in TYPES])


@query(_interpolated_sql("p"))
def interpolated_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpolated(spark, sf_dir, "linear")


@query(_interpolated_sql("epoch_us(ts)"))
def interpolated_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpolated(spark, sf_dir, "time")


@query(f"""WITH {WIDE_SQL} SELECT event_id, ts, user_id AS machine_id, {", ".join(
    f"last_value({t} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {t}" for t in TYPES)},
  last_value(CASE WHEN purchase > 20 THEN 'high' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS state FROM wide""")
def imputed_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and states of every machine padded, each column exactly once."""
    rows = wide(spark, sf_dir, None).withColumn("state", F.when(F.col("purchase") > 20, "high"))
    return fill.impute(rows, keys=["machine_id"])


@query(f"""WITH {WIDE_SQL} SELECT * FROM ({" UNION ALL ".join(
    f'''SELECT user_id AS machine_id, '{t}' AS "column", min(ts) FILTER ({t} IS NOT NULL) AS first_ts, max(ts) FILTER ({t} IS NOT NULL) AS last_ts FROM wide GROUP BY user_id'''
    for t in TYPES)})""")
def valid_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.valid_ranges(wide(spark, sf_dir, None), TYPES)


@query(f"""WITH {WIDE_SQL}, r AS (SELECT user_id,
  greatest({", ".join(f"min(ts) FILTER ({t} IS NOT NULL)" for t in TYPES)}) AS lo,
  least({", ".join(f"max(ts) FILTER ({t} IS NOT NULL)" for t in TYPES)}) AS hi FROM wide GROUP BY user_id)
SELECT w.user_id AS machine_id, w.ts, w.event_id, {", ".join("w." + t for t in TYPES)} FROM wide w JOIN r ON r.user_id = w.user_id WHERE w.ts BETWEEN r.lo AND r.hi""")
def sliced_to_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.slice_valid(wide(spark, sf_dir, None), TYPES, extrapolate=False)


@query("""SELECT event_id, 'kind.' || event_type AS series, 1 AS value FROM events
UNION ALL SELECT event_id, 'day.' || CAST(day(ts) AS VARCHAR), 1 FROM events""")
def one_hot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS kind", "day(ts) AS day")
    return encode.one_hot_long(rows, ["kind", "day"], ["event_id"])


@query("""SELECT o_orderkey, o_totalprice, """ + ", ".join(
    f"""CAST(o_orderstatus = '{s}' AS INT) AS status_{s.lower()}""" for s in "FOP") + " FROM orders")
def one_hot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice", "o_orderstatus AS status")
    encoded = encode.one_hot(rows, None, ["o_orderkey"])
    return encoded.toDF(*[c.replace(".", "_").lower() for c in encoded.columns])


@query("SELECT event_id, value FROM events")
def error_codes_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).selectExpr("event_id", "value", "code AS `c1.conditions.logic.errorCode`", "code AS `target.errorCode`")
    return cleansing.drop_error_codes(rows, "target.errorCode", skip=False).select("event_id", "value")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "double_quantity", "price_and_tax"]


def _with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "2 * l_quantity AS double_quantity",
        "l_extendedprice * (1 + l_tax) AS price_and_tax")


_COPIES_SQL = "c AS (SELECT *, 2 * l_quantity AS double_quantity, l_extendedprice * (1 + l_tax) AS price_and_tax FROM lineitem)"


@query("WITH " + _COPIES_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {sql_r6(f'corr({a}, {b})')} AS r FROM c" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]) + ")")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleansing.correlations(_with_copies(spark, sf_dir), _CORR)
    report = spark.createDataFrame([(a, b, r) for (a, b), r in found.items()], "a string, b string, r double")
    return report.withColumn("r", r6(F.col("r")))


@query("WITH " + _COPIES_SQL + " SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM c")
def correlated_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy and the near copy go, their earlier originals stay."""
    return cleansing.drop_correlated(_with_copies(spark, sf_dir), 0.99, _CORR)


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def mode_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modes selected, a third one open, one mapped column absent."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    modes = {"status": ("ALL", "F", "O", "P"), "priority": ("ALL", "1-URGENT", "2-HIGH"), "open": ("ALL",)}
    columns = {"status": ("o_orderstatus", "absent"), "priority": ("o_orderpriority",), "open": ("o_orderkey",)}
    return cleansing.filter_modes(rows, {"status": ["F", "P"], "priority": ["1-URGENT"], "open": ["ALL"]}, modes, columns)


def _outlier_sql(join: str) -> str:
    out = " {} ".format(join).join(
        f"coalesce({c} < {c}_m - 1.5 * {c}_s OR {c} > {c}_m + 1.5 * {c}_s, false)" for c in ("l_quantity", "l_extendedprice"))
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in ("l_quantity", "l_extendedprice"))
    return f"SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem, (SELECT {stats} FROM lineitem) WHERE NOT ({out})"


def _without_outliers(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return cleansing.drop_outliers(rows, 1.5, how, ["l_quantity", "l_extendedprice"])


@query(_outlier_sql("AND"))
def outliers_in_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_outliers(spark, sf_dir, "all")


@query(_outlier_sql("OR"))
def outliers_in_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_outliers(spark, sf_dir, "any")

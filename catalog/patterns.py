"""P1-P10 on the benchmark tables: window 7200 s, gap 3600 s, more than 3 rows, support 0.2, confidence 0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.base import LOG_SQL, PLANT, log, query, r6, sql_r6, table
from faultline.operators import patterns
from faultline.params import OK_CODE, MiningParams
from faultline.session import settle

GAP, WINDOW, OBS, SUPPORT, CONFIDENCE = 3600, 7200, 3, 0.2, 0.5


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, PLANT).selectExpr("machine_id AS source_file", "ts", "event_id", "code")


_RUNS = f"""b AS (SELECT *, CASE WHEN lag(code) OVER (ORDER BY ts) IS DISTINCT FROM code THEN 1 ELSE 0 END AS s FROM log),
i AS (SELECT *, sum(s) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM b),
runs AS (SELECT code, min(ts) AS run_start, max(ts) AS run_end FROM i WHERE code <> {OK_CODE} GROUP BY code, island)"""

_SPACED = f"""spaced AS (SELECT * FROM (SELECT *, lag(run_end) OVER (PARTITION BY code ORDER BY run_start) AS prev_end FROM runs)
WHERE prev_end IS NULL OR epoch_us(run_start) - epoch_us(prev_end) > {GAP}000000)"""

_ITEMSETS = f"""w AS (SELECT s.code AS error_code, s.run_start, count(*) AS n_rows,
  list_sort(coalesce(list(DISTINCT l.code) FILTER (l.code <> {OK_CODE}), [])) AS items
  FROM spaced s JOIN log l ON l.ts >= s.run_start - INTERVAL {WINDOW} SECOND AND l.ts < s.run_start
  GROUP BY s.code, s.run_start HAVING count(*) > {OBS})"""

# All itemsets by joining items of a window in ascending order, level by level.
def _frequent_sql(support: float) -> str:
    return f"""n AS (SELECT error_code, count(*) AS n_windows, CAST(ceil(count(*) * {support}) AS BIGINT) AS need FROM w GROUP BY 1 HAVING count(*) >= 2),
it AS (SELECT w.error_code, w.run_start, CAST(unnest(items) AS BIGINT) AS item FROM w),
lvl AS (SELECT error_code, run_start, [item] AS itemset FROM it
  UNION ALL SELECT l.error_code, l.run_start, list_append(l.itemset, i.item) FROM lvl l JOIN it i
  ON i.error_code = l.error_code AND i.run_start = l.run_start AND i.item > l.itemset[-1]),
f AS (SELECT l.error_code, n.n_windows, l.itemset, count(*) AS support, n.need FROM lvl l JOIN n ON n.error_code = l.error_code
  GROUP BY ALL HAVING count(*) >= n.need)"""


_FREQUENT = _frequent_sql(SUPPORT)

_TEXT = "array_to_string({}, ',')"


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.spaced_runs(settle(patterns.error_runs(_coded(spark, sf_dir), tie=["event_id"]), "runs"), GAP)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.itemsets(_coded(spark, sf_dir), _spaced(spark, sf_dir), WINDOW, OBS, ["code"])


def _joined(items: str) -> Column:
    return F.array_join(F.transform(items, lambda i: i.cast("string")), ",")


@query(f"""WITH p AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 END AS a,
  CASE WHEN event_type = 'view' THEN 200 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 END AS b FROM events),
f AS (SELECT user_id, ts, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM p
  WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, greatest(min(ts) FILTER (a IS NOT NULL), min(ts) FILTER (b IS NOT NULL)) AS t0 FROM f GROUP BY 1)
SELECT f.user_id AS source_file, ts, a AS error_a, b AS error_b FROM f JOIN s ON s.user_id = f.user_id AND f.ts >= s.t0""")
def prepared_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two code columns per file (user), filled and trimmed to where both are known."""
    rows = _two_columns(spark, sf_dir, None)
    return patterns.prepare(rows).toDF("source_file", "ts", "error_a", "error_b")


def _two_columns(spark: SparkSession, sf_dir: str, owner: str | None) -> DataFrame:


    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") if owner is None else F.lit(owner)).alias("source_file"), "ts",
        F.when(F.col("event_type") == "error", 100 + k % 10).alias("a.errorCode"),
        F.when(F.col("event_type") == "view", 200 + k % 5).alias("b.errorCode"))


@query(f"WITH {LOG_SQL}, {_RUNS} SELECT '{PLANT}' AS source_file, code, run_start, run_end FROM runs")
def error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.error_runs(_coded(spark, sf_dir), tie=["event_id"])


@query(f"WITH {LOG_SQL}, {_RUNS}, {_SPACED} SELECT '{PLANT}' AS source_file, code, run_start, run_end, prev_end FROM spaced")
def spaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the end of the code's previous run, where the gap is long enough."""
    return _spaced(spark, sf_dir)


@query(f"WITH {LOG_SQL}, {_RUNS}, {_SPACED}, {_ITEMSETS} SELECT error_code, run_start, CAST(n_rows AS BIGINT) AS n_rows, {_TEXT.format('items')} AS items FROM w")
def error_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("error_code", "run_start", "n_rows", _joined("items").alias("items"))


@query(f"WITH RECURSIVE {LOG_SQL}, {_RUNS}, {_SPACED}, {_ITEMSETS}, {_FREQUENT} SELECT error_code, n_windows, {_TEXT.format('itemset')} AS itemset, support, {sql_r6('support / n_windows')} AS support_rel FROM f")
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.frequent_itemsets(_windows(spark, sf_dir), SUPPORT)
    return found.select("error_code", "n_windows", _joined("itemset").alias("itemset"), "support", r6(F.col("support_rel")).alias("support_rel"))


@query(f"""WITH RECURSIVE {LOG_SQL}, {_RUNS}, {_SPACED}, {_ITEMSETS}, {_FREQUENT}
SELECT s.error_code, {_TEXT.format('a.itemset')} AS antecedent, {_TEXT.format('list_sort(list_filter(s.itemset, lambda x: NOT list_contains(a.itemset, x)))')} AS consequent,
  {sql_r6('s.support / a.support')} AS confidence
FROM f s JOIN f a ON a.error_code = s.error_code AND len(a.itemset) < len(s.itemset) AND list_has_all(s.itemset, a.itemset)
WHERE s.support / a.support >= {CONFIDENCE}""")
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequent = settle(patterns.frequent_itemsets(_windows(spark, sf_dir), SUPPORT), "itemsets")
    rules = patterns.association_rules(frequent, CONFIDENCE)
    return rules.select("error_code", _joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"),
                        r6(F.col("confidence")).alias("confidence"))


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_JOB = f"""p AS (SELECT ts, CASE WHEN event_type = 'error' THEN 100 + {_K} % 10 END AS a, CASE WHEN event_type = 'view' THEN 200 + {_K} % 5 END AS b FROM events),
filled AS (SELECT ts, CAST(last_value(a IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS code, last_value(b IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM p),
log AS (SELECT * FROM filled WHERE code IS NOT NULL AND b IS NOT NULL),
{_RUNS}, {_SPACED},
w AS (SELECT s.code AS error_code, s.run_start, list_sort(list_distinct(list_concat(list(DISTINCT l.code), list(DISTINCT CAST(l.b AS BIGINT))))) AS items
  FROM spaced s JOIN log l ON l.ts >= s.run_start - INTERVAL {WINDOW} SECOND AND l.ts < s.run_start GROUP BY s.code, s.run_start HAVING count(*) > {OBS}), {_frequent_sql(0.5)}"""


@query(f"""WITH RECURSIVE {_JOB}
SELECT error_code, 'set' AS kind, {_TEXT.format('itemset')} AS items, {sql_r6('support / n_windows')} AS score FROM f
UNION ALL SELECT s.error_code, 'rule', {_TEXT.format('a.itemset')} || ' => ' || {_TEXT.format('list_sort(list_filter(s.itemset, lambda x: NOT list_contains(a.itemset, x)))')}, {sql_r6('s.support / a.support')}
FROM f s JOIN f a ON a.error_code = s.error_code AND len(a.itemset) < len(s.itemset) AND list_has_all(s.itemset, a.itemset) WHERE s.support / a.support >= {CONFIDENCE}""")
def mined_across_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on two code columns: itemsets over both, before errors of the first."""
    params = MiningParams("a.errorCode", GAP, OBS, WINDOW, True, 0.5, CONFIDENCE)
    frequent, rules = patterns.mine(_two_columns(spark, sf_dir, PLANT), params)
    sets = frequent.select("error_code", F.lit("set").alias("kind"), _joined("itemset").alias("items"), r6(F.col("support_rel")).alias("score"))
    return sets.unionByName(rules.select(
        "error_code", F.lit("rule").alias("kind"),
        F.concat_ws(" => ", _joined("antecedent"), _joined("consequent")).alias("items"), r6(F.col("confidence")).alias("score")))



"""F1-F9 on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import LOG_SQL, PLANT, TARGET, log, query
from faultline.operators import encode, labels, windows
from faultline.params import OK_CODE, Horizon, PredictionParams
from faultline.plans import prediction

HOUR = Horizon(3600, 3600)
SEED = 100


def kept_sql(target: int, gap_seconds: int, prefix: str = "") -> str:
    """CTEs ``{prefix}kept(us)``: greedy thinning of one stream by following successors."""
    gap = gap_seconds * 1_000_000
    return f"""{prefix}e AS (SELECT DISTINCT epoch_us(ts) AS us FROM log WHERE code = {target}),
{prefix}nx AS (SELECT a.us, min(b.us) AS nx FROM {prefix}e a LEFT JOIN {prefix}e b ON b.us > a.us + {gap} GROUP BY a.us),
{prefix}kept AS (SELECT min(us) AS us FROM {prefix}e UNION ALL
  SELECT n.nx FROM {prefix}kept k JOIN {prefix}nx n ON n.us = k.us WHERE n.nx IS NOT NULL)"""


def negatives_sql(horizon: Horizon = HOUR) -> str:
    low, high = horizon.pw * 1_000_000, horizon.reach * 1_000_000
    return f"""neg AS (SELECT ts, code FROM log c WHERE code <> {TARGET} AND NOT EXISTS (
  SELECT 1 FROM log e WHERE e.code = {TARGET} AND epoch_us(c.ts) BETWEEN epoch_us(e.ts) + {low} AND epoch_us(e.ts) + {high}))"""


def draw_sql(seed: int, *parts: str) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.code_series(log(spark, sf_dir, PLANT), "code")


def positives(spark: SparkSession, sf_dir: str, horizon: Horizon = HOUR) -> DataFrame:
    return labels.positive_examples(codes(spark, sf_dir), TARGET, horizon)


def negatives(spark: SparkSession, sf_dir: str, horizon: Horizon = HOUR) -> DataFrame:
    return labels.negative_candidates(codes(spark, sf_dir), TARGET, horizon)


@query(f"WITH {LOG_SQL} SELECT '{PLANT}' AS machine_id, ts, code FROM log")
def target_code_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir)


def _runs_sql(code: int) -> str:
    return (f"CASE WHEN kind = {code} THEN row_number() OVER (ORDER BY ts, event_id) - "
            f"coalesce(max(CASE WHEN kind <> {code} THEN p END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END")


@query(f"""WITH n AS (SELECT event_id, ts, CASE WHEN event_type IN ('error', 'view') THEN 7 WHEN event_type = 'click' THEN 8 ELSE {OK_CODE} END AS kind,
  row_number() OVER (ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CAST({_runs_sql(7)} AS BIGINT) AS run_7, CAST({_runs_sql(OK_CODE)} AS BIGINT) AS run_ok FROM n""")
def consecutive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir, PLANT).withColumn(
        "kind", F.when(F.col("event_type").isin("error", "view"), 7).when(F.col("event_type") == "click", 8).otherwise(OK_CODE))
    done = labels.consecutive(rows, "kind", 7, tie=["event_id"])
    return done.select("event_id", F.col("`kind.7.consecutiveErrors`").alias("run_7"),
                       F.col(f"`kind.{OK_CODE}.consecutiveErrors`").alias("run_ok"))


@query(f"WITH {LOG_SQL} SELECT event_id, " + ", ".join(
    f"CAST(code = {c} AS INT) AS code_{c}_occured" for c in range(100, 110)) + " FROM log")
def error_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("event_id", F.nullif("code", F.lit(OK_CODE)).alias("code"))
    return encode.error_occurrence(rows, ["code"], ["event_id"])


@query(f"WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)} SELECT '{PLANT}' AS machine_id, make_timestamp(us) AS ts, {TARGET} AS code FROM kept")
def positive_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One machine owns every error; short segments are folded in parallel."""
    return positives(spark, sf_dir)


@query(f"WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 172800)} SELECT '{PLANT}' AS machine_id, make_timestamp(us) AS ts, {TARGET} AS code FROM kept")
def positive_examples_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors so dense that they form one long segment: successor pointers with doubling."""
    return labels.positive_examples(codes(spark, sf_dir), TARGET, Horizon(86400, 86400), fold_limit=50)


@query(f"WITH {LOG_SQL}, {negatives_sql()} SELECT '{PLANT}' AS machine_id, ts, code FROM neg")
def negative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives(spark, sf_dir)


@query(f"""WITH f AS (SELECT user_id, ts, last_value(CASE WHEN event_type = 'error' THEN 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS code FROM events),
{LOG_SQL} SELECT user_id AS machine_id, ts, CAST(code AS BIGINT) AS code FROM f WHERE code <> {TARGET} AND NOT EXISTS (
  SELECT 1 FROM log e WHERE e.user_id = f.user_id AND e.code = {TARGET} AND epoch_us(f.ts) BETWEEN epoch_us(e.ts) + 3600000000 AND epoch_us(e.ts) + 90000000000)""")
def negative_candidates_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes are sparse and filled forward first; every user is a machine."""
    sparse = log(spark, sf_dir).withColumn("code", F.nullif("code", F.lit(OK_CODE)))
    return labels.negative_candidates(labels.code_series(sparse, "code"), TARGET, Horizon(3600, 86400))


@query(f"WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)}, {kept_sql(TARGET, 172800, 'd')} SELECT '{PLANT}' AS machine_id, make_timestamp(us) AS ts FROM kept WHERE us NOT IN (SELECT us FROM dkept)")
def unprocessed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = positives(spark, sf_dir, Horizon(86400, 86400))
    return labels.not_processed(positives(spark, sf_dir), done).select("machine_id", "ts")


@query(f"""WITH {LOG_SQL}, {negatives_sql()}
SELECT '{PLANT}' AS machine_id, ts, code FROM neg ORDER BY {draw_sql(SEED, f"'{PLANT}'", "epoch_us(ts)")}, epoch_us(ts) LIMIT 500""")
def sampled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-iteration draw of up to 500 examples."""
    return labels.sample_examples(negatives(spark, sf_dir), 500, SEED)


@query(f"""WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)}, {negatives_sql()},
r AS (SELECT ts, row_number() OVER (ORDER BY {draw_sql(SEED, f"'{PLANT}'", "epoch_us(ts)")}, epoch_us(ts)) AS rn FROM neg)
SELECT '{PLANT}' AS machine_id, ts FROM r WHERE rn <= (SELECT ceil(count(*) * (1 / 0.4 - 1)) FROM kept)""")
def balanced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives are to make up 40 percent of the examples."""
    return labels.balanced_negatives(positives(spark, sf_dir), negatives(spark, sf_dir), 0.4, SEED).select("machine_id", "ts")


@query(f"""WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)}
SELECT '{PLANT}' AS machine_id, make_timestamp(k.us) AS example_ts, make_timestamp(k.us - 7200000000) AS window_start, make_timestamp(k.us - 3600000000) AS window_end,
  3600 AS window_length, count(e.ts) AS samples_used FROM kept k LEFT JOIN events e ON epoch_us(e.ts) BETWEEN k.us - 7200000000 AND k.us - 3600000000 GROUP BY k.us""")
def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and number of timeline rows per example; empty windows count as processed."""
    examples = windows.with_windows(positives(spark, sf_dir).select("machine_id", "ts"), HOUR)
    return windows.samples_used(log(spark, sf_dir, PLANT), examples, HOUR.rw, drop_empty=False)


@query(f"""WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)}
SELECT make_timestamp(k.us) AS example_ts, e.event_id, e.value FROM kept k JOIN events e ON epoch_us(e.ts) BETWEEN k.us - 7200000000 AND k.us - 3600000000""")
def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = windows.with_windows(positives(spark, sf_dir).select("machine_id", "ts"), HOUR)
    samples = log(spark, sf_dir, PLANT).select("machine_id", "ts", "event_id", "value")
    return windows.window_samples(samples, examples, HOUR.rw).select("example_ts", "event_id", "value")




@query(f"""WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, 7200)}, {negatives_sql()},
n AS (SELECT ts, code, row_number() OVER (ORDER BY {draw_sql(SEED, f"'{PLANT}'", "epoch_us(ts)")}, epoch_us(ts)) AS rn FROM neg)
SELECT '{PLANT}' AS machine_id, make_timestamp(us) AS ts, CAST({TARGET} AS BIGINT) AS code FROM kept
UNION ALL SELECT '{PLANT}', ts, code FROM n WHERE rn <= (SELECT ceil(count(*) * (1 / 0.4 - 1)) FROM kept)""")
def prediction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store holds every positive and far more negatives than the balance of 40 percent allows."""
    params = PredictionParams(target_code=TARGET, horizon=Horizon(3600, 3600), balance_ratio=0.4, seeds=(SEED,))
    stored = positives(spark, sf_dir).select("machine_id", "ts", "code").unionByName(negatives(spark, sf_dir).select("machine_id", "ts", "code"))
    return prediction.stored_for_balance(stored, codes(spark, sf_dir), params).withColumn("code", F.col("code").cast("bigint"))

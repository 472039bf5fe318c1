"""F10-F19 and the extended features on the benchmark tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from catalog.base import LOG_SQL, ORACLES, PLANT, TARGET, TYPES, log, query, r6, sql_r6
from catalog.labels import HOUR, SEED, draw_sql, kept_sql, negatives, negatives_sql, positives
from faultline.operators import catalogue, features, labels, windows
from faultline.operators.features import MINIMAL
from faultline.params import Horizon
from faultline.session import settle

DAY = Horizon(3600, 86400)
EXAMPLE = ["example_ts", "series"]
_START = f"WITH RECURSIVE {LOG_SQL}, {kept_sql(TARGET, HOUR.reach)}"

_MINIMAL_SQL = {
    "sum_values": sql_r6("sum(value)"), "median": sql_r6("median(value)"), "mean": sql_r6("avg(value)"), "length": "count(value)",
    "standard_deviation": sql_r6("stddev_pop(value)"), "variance": sql_r6("var_pop(value)"), "maximum": sql_r6("max(value)"),
    "minimum": sql_r6("min(value)"),
}
_MINIMAL_LIST = ", ".join(f"{e} AS {n}" for n, e in _MINIMAL_SQL.items())


def rounded(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All doubles with six decimals."""
    return df.select(*[
        r6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in keep else F.col(f.name)
        for f in df.schema.fields
    ])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, PLANT).select("machine_id", "ts", "event_id", F.col("event_type").alias("series"), "value")


def pairs_before_errors(spark: SparkSession, sf_dir: str, horizon: Horizon = HOUR) -> DataFrame:
    examples = windows.with_windows(positives(spark, sf_dir).select("machine_id", "ts"), horizon)
    return windows.window_samples(samples(spark, sf_dir), examples, horizon.rw)


def pairs_sql(horizon: Horizon = HOUR, kept: str = "kept") -> str:
    return f"""pairs AS (SELECT make_timestamp(k.us) AS example_ts, e.event_type AS series, e.ts, e.event_id, e.value FROM {kept} k
  JOIN events e ON epoch_us(e.ts) BETWEEN k.us - {horizon.reach}000000 AND k.us - {horizon.pw}000000)"""


@query(f"{_START}, {pairs_sql()} SELECT example_ts, series, {_MINIMAL_LIST} FROM pairs GROUP BY 1, 2")
def features_before_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: codes -> thinned errors -> reading windows -> minimal features."""
    return rounded(features.minimal_features(pairs_before_errors(spark, sf_dir), EXAMPLE))


_NEG = f"""{negatives_sql()}, drawn AS (SELECT epoch_us(ts) AS us, code, row_number() OVER (ORDER BY {draw_sql(SEED, f"'{PLANT}'", "epoch_us(ts)")}, epoch_us(ts)) AS rn FROM neg),
examples AS (SELECT us, {TARGET} AS code FROM kept UNION ALL SELECT us, code FROM drawn WHERE rn <= (SELECT count(*) FROM kept))"""

_EXAMPLE_PAIRS = f"""pairs AS (SELECT make_timestamp(k.us) AS example_ts, k.code, e.event_type AS series, e.value FROM examples k
  JOIN events e ON epoch_us(e.ts) BETWEEN k.us - {HOUR.reach}000000 AND k.us - {HOUR.pw}000000)"""


def example_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and as many negatives, with window bounds."""
    errors = settle(positives(spark, sf_dir), "positives")
    others = labels.balanced_negatives(errors, negatives(spark, sf_dir), 0.5, SEED)
    both = errors.select("machine_id", "ts", "code").unionByName(others.select("machine_id", "ts", "code"))
    return windows.with_windows(both, HOUR)


def example_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = windows.window_samples(samples(spark, sf_dir), example_set(spark, sf_dir), HOUR.rw)
    return features.minimal_features(pairs, ["example_ts", "code", "series"])


@query(f"{_START}, {_NEG}, {_EXAMPLE_PAIRS} SELECT example_ts, CAST(code AS BIGINT) AS code, series, {_MINIMAL_LIST} FROM pairs GROUP BY 1, 2, 3")
def example_set_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and balanced negatives in one job."""
    return rounded(example_features(spark, sf_dir))


def _horizon_sql(h: Horizon) -> str:
    return (f"SELECT {h.pw} AS pw, {h.rw} AS rw, make_timestamp(k.us) AS example_ts, e.event_type AS series, e.value FROM kept k "
            f"JOIN events e ON epoch_us(e.ts) BETWEEN k.us - {h.reach}000000 AND k.us - {h.pw}000000")


@query(f"""{_START}, {pairs_sql()}, t AS (SELECT DISTINCT event_type AS series FROM events), d AS (SELECT p.example_ts, t.series, CAST(p.series = t.series AS INT) AS value FROM pairs p, t)
SELECT example_ts, series, {_MINIMAL_LIST} FROM d GROUP BY 1, 2""")
def category_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot series without ever writing their zeros: features from row counts."""
    bounded = windows.with_windows(positives(spark, sf_dir).select("machine_id", "ts"), HOUR)
    present = log(spark, sf_dir, PLANT).select("machine_id", "ts", F.col("event_type").alias("series"))
    rows = windows.samples_used(present, bounded, HOUR.rw).select("example_ts", F.col("samples_used").alias("n"))
    every = rows.withColumn("series", F.explode(F.array(*[F.lit(t) for t in TYPES])))
    ones = windows.window_samples(present, bounded, HOUR.rw).groupBy(*EXAMPLE).agg(F.count(F.lit(1)).alias("ones"))
    return rounded(features.indicator_features(every.join(ones, EXAMPLE, "left")))


_HORIZONS = (Horizon(3600, 3600), Horizon(1800, 7200), Horizon(7200, 14400))


@query(f"{_START}, pairs AS ({' UNION ALL '.join(_horizon_sql(h) for h in _HORIZONS)}) SELECT pw, rw, example_ts, series, {_MINIMAL_LIST} FROM pairs GROUP BY 1, 2, 3, 4")
def features_for_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several (PW, RW) pairs in one job instead of one pass each."""
    examples = windows.for_horizons(positives(spark, sf_dir).select("machine_id", "ts"), _HORIZONS)
    pairs = windows.window_samples(samples(spark, sf_dir), examples, max(h.rw for h in _HORIZONS))
    return rounded(features.minimal_features(pairs, ["pw", "rw", *EXAMPLE]))


_LONG = " UNION ALL ".join(
    f"SELECT example_ts, series || '__{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM feats" for n in MINIMAL)
_RAW_LIST = ", ".join(f"{e} AS {n}" for n, e in {
    "sum_values": "sum(value)", "median": "median(value)", "mean": "avg(value)", "length": "count(value)",
    "standard_deviation": "stddev_pop(value)", "variance": "var_pop(value)", "maximum": "max(value)", "minimum": "min(value)"}.items())


@query(f"""{_START}, {pairs_sql()}, feats AS (SELECT example_ts, series, {_RAW_LIST} FROM pairs GROUP BY 1, 2), long AS ({_LONG}),
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM long GROUP BY 1)
SELECT l.example_ts, l.feature, round(CASE WHEN s.sd > 1e-9 THEN (l.value - s.m) / s.sd ELSE 0 END, 5) + 0.0 AS value
FROM long l JOIN s ON s.feature = l.feature WHERE NOT (ends_with(l.feature, '__sum_values') OR ends_with(l.feature, '__length'))""")
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features, z-scores, count-like features dropped."""
    feats = features.minimal_features(pairs_before_errors(spark, sf_dir), EXAMPLE)
    long = settle(features.features_long(feats, EXAMPLE), "features")
    scaled = features.drop_count_features(features.standardise_long(long))
    return scaled.withColumn("value", F.round("value", 5) + F.lit(0.0))


_SCALES = {"min_max": ("min(value)", "max(value) - min(value)"), "robust": ("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"), "max_abs": ("0.0", "max(abs(value))")}


@query(f"""{_START}, {pairs_sql()}, feats AS (SELECT example_ts, series, {_RAW_LIST} FROM pairs GROUP BY 1, 2), long AS ({_LONG}),
s AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS scaler, feature, {a} AS c, {b} AS w FROM long GROUP BY feature" for k, (a, b) in _SCALES.items()) + """)
SELECT s.scaler, l.example_ts, l.feature, """ + sql_r6("(CASE WHEN s.w > 1e-9 THEN (l.value - s.c) / s.w ELSE l.value - s.c END)") + " AS value FROM long l JOIN s ON s.feature = l.feature")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features with each of the other scalers."""
    feats = features.minimal_features(pairs_before_errors(spark, sf_dir), EXAMPLE)
    long = settle(features.features_long(feats, EXAMPLE), "features")
    parts = [features.scale_long(long, name).select(F.lit(name).alias("scaler"), "example_ts", "feature", "value") for name in _SCALES]
    return reduce(DataFrame.unionByName, parts).withColumn("value", r6(F.col("value")))


@query(f"""{_START}, {_NEG}, {_EXAMPLE_PAIRS}, f AS (SELECT example_ts, code, series, {_MINIMAL_LIST} FROM pairs GROUP BY 1, 2, 3)
SELECT example_ts, {", ".join(f"max({f}) FILTER (series = '{t}') AS {t}_{f}" for t in TYPES for f in MINIMAL if f not in ("sum_values", "length"))}, CASE WHEN any_value(code) = {TARGET} THEN {TARGET} ELSE -1 END AS label
FROM f GROUP BY example_ts, code""")
def labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all series side by side without metadata, and the two-class label."""
    wide = features.features_wide(example_features(spark, sf_dir), ["example_ts", "code", "series"], TYPES, MINIMAL)
    labelled = features.with_label(features.drop_metadata(wide), "code", TARGET).drop("code")
    return rounded(labelled.toDF(*[c.replace("__", "_") for c in labelled.columns]))


@query()
def assembled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors from long features: position and number of entries per example."""
    feats = features.minimal_features(pairs_before_errors(spark, sf_dir), EXAMPLE)
    long = settle(features.features_long(feats, EXAMPLE), "features")
    index = settle(features.feature_index(long), "index")
    packed = features.assemble_long(long, ["example_ts"], index, index.count())
    return packed.select("example_ts", F.col("features").cast("string").alias("features"))


# Extended features: windows of one day before each error; ties in time are ordered by event_id.
ORDER = ["ts", "event_id"]
_DAY_PAIRS = f"{_START}, {pairs_sql(DAY)}"
_MOMENTS = """m AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sigma, min(value) OVER w AS lo, max(value) OVER w AS hi,
  row_number() OVER (PARTITION BY example_ts, series ORDER BY ts, event_id) - 1 AS i FROM pairs WINDOW w AS (PARTITION BY example_ts, series))"""


def _day_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_before_errors(spark, sf_dir, DAY)


def _named(name: str) -> str:
    return name.replace("__", "_").lower()


def _shown(df: DataFrame) -> DataFrame:
    """Snake-case names, six decimals."""
    return rounded(df.toDF(*[_named(c) for c in df.columns]))


def _more(x: str, limit: str) -> str:
    """x > limit by more than rounding."""
    return f"{x} > ({limit}) * (1 + 1e-9) + 1e-15"


_Q = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
_SIGMAS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 6.0, 7.0, 10.0)
_TWENTIETHS = [round(0.05 * r, 2) for r in range(20)]


@query(f"""{_DAY_PAIRS}, {_MOMENTS}, g AS (SELECT example_ts, series, any_value(n) AS n, any_value(mu) AS mu, any_value(sigma) AS sigma, any_value(lo) AS lo, any_value(hi) AS hi,
  sum(value * value) AS abs_energy, median(value) AS med, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4,
  count(*) FILTER ({_more("value - mu", "1e-9 * abs(mu)")}) AS count_above_mean, count(*) FILTER ({_more("mu - value", "1e-9 * abs(mu)")}) AS count_below_mean,
  avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0.0 END) AS ca, avg(CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END) AS cb,
  count(*) FILTER (value >= -1 AND value < 1) AS rc, count(*) FILTER (value = 0) AS v0, count(*) FILTER (value = 1) AS v1, count(*) FILTER (value = -1) AS vm1,
  {", ".join(f"quantile_cont(value, {q}) AS q{i}" for i, q in enumerate(_Q))},
  {", ".join(f"avg(CASE WHEN {_more('abs(value - mu)', f'{r} * sigma')} THEN 1.0 ELSE 0.0 END) AS s{i}" for i, r in enumerate(_SIGMAS))}
  FROM m GROUP BY 1, 2)
SELECT example_ts, series, {sql_r6("abs_energy")} AS abs_energy, count_above_mean, count_below_mean, {sql_r6("ca")} AS count_above_t_0_0, {sql_r6("cb")} AS count_below_t_0_0,
  rc AS range_count_min_m1_0_max_1_0, v0 AS value_count_v_0_0, v1 AS value_count_v_1_0, vm1 AS value_count_v_m1_0,
  {", ".join(f"{sql_r6(f'q{i}')} AS quantile_q_{str(q).replace('.', '_')}" for i, q in enumerate(_Q))},
  {", ".join(f"{sql_r6(f's{i}')} AS ratio_beyond_r_sigma_r_{str(r).replace('.', '_')}" for i, r in enumerate(_SIGMAS))},
  {sql_r6("CASE WHEN n >= 3 THEN CASE WHEN m2 > 0 THEN sqrt(n * (n - 1)) / (n - 2) * m3 / m2 ** 1.5 ELSE 0 END END")} AS skewness,
  {sql_r6("CASE WHEN n >= 4 THEN CASE WHEN m2 > 0 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - 3 * (n - 1)) ELSE 0 END END")} AS kurtosis,
  CAST(m2 > sqrt(m2) AS INT) AS variance_larger_than_standard_deviation,
  {", ".join(f"CAST({_more('sigma', f'{r} * (hi - lo)')} AS INT) AS large_standard_deviation_r_{str(r).replace('.', '_')}, CAST({_more(f'{r} * (hi - lo)', 'abs(mu - med)')} AS INT) AS symmetry_looking_r_{str(r).replace('.', '_')}" for r in _TWENTIETHS[1:])},
  CAST({_more('0.0 * (hi - lo)', 'abs(mu - med)')} AS INT) AS symmetry_looking_r_0_0
FROM g""")
def extended_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(catalogue.plain_features(_day_pairs(spark, sf_dir), EXAMPLE))


def _duplicates_sql(value: str) -> str:
    return f"""{_DAY_PAIRS}, r AS (SELECT example_ts, series, {value} AS value FROM pairs), c AS (SELECT example_ts, series, value, count(*) AS c FROM r GROUP BY 1, 2, 3)
SELECT example_ts, series, CAST(max(c) > 1 AS INT) AS has_duplicate, CAST(arg_max(c, value) > 1 AS INT) AS has_duplicate_max, CAST(arg_min(c, value) > 1 AS INT) AS has_duplicate_min,
  {sql_r6("avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END)")} AS percentage_of_reoccurring_values_to_all_values,
  {sql_r6("coalesce(sum(c) FILTER (c > 1), 0) / sum(c)")} AS percentage_of_reoccurring_datapoints_to_all_datapoints,
  {sql_r6("coalesce(sum(value) FILTER (c > 1), 0)")} AS sum_of_reoccurring_values, {sql_r6("coalesce(sum(value * c) FILTER (c > 1), 0)")} AS sum_of_reoccurring_data_points,
  {sql_r6("count(*) / sum(c)")} AS ratio_value_number_to_time_series_length FROM c GROUP BY 1, 2"""


@query(_duplicates_sql("round(value / 10)"))
def extended_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On values rounded to tens, so that values repeat."""
    pairs = _day_pairs(spark, sf_dir).withColumn("value", F.round(F.col("value") / 10))
    return _shown(catalogue.duplicate_features(pairs, EXAMPLE))


_CORRIDORS = [(low / 5, high / 5) for low in range(5) for high in range(low + 1, 6)]


def _corridor_sql(i: int, low: float, high: float) -> str:
    name = f"change_quantiles_ql_{str(low).replace('.', '_')}_qh_{str(high).replace('.', '_')}"
    inside = f"FILTER (value BETWEEN a{i} AND b{i} AND l1 BETWEEN a{i} AND b{i})"
    return ", ".join(f"{sql_r6(f'coalesce({f}({x}) {inside}, 0)')} AS {name}_isabs_{absolute}_f_agg_{out}"
                     for absolute, x in (("true", "abs(l1 - value)"), ("false", "l1 - value")) for f, out in (("avg", "mean"), ("var_pop", "var")))


@query(f"""{_DAY_PAIRS}, {_MOMENTS}, l AS (SELECT *, {", ".join(f"lead(value, {k}) OVER w AS l{k}" for k in (1, 2, 3, 4, 6))} FROM m WINDOW w AS (PARTITION BY example_ts, series ORDER BY i)),
q AS (SELECT example_ts, series, {", ".join(f"quantile_cont(value, {a}) AS a{i}, quantile_cont(value, {b}) AS b{i}" for i, (a, b) in enumerate(_CORRIDORS))} FROM pairs GROUP BY 1, 2),
j AS (SELECT l.*, q.* EXCLUDE (example_ts, series) FROM l JOIN q ON q.example_ts = l.example_ts AND q.series = l.series)
SELECT example_ts, series, {sql_r6("avg(abs(l1 - value))")} AS mean_abs_change, {sql_r6("coalesce(sum(abs(l1 - value)), 0)")} AS absolute_sum_of_changes,
  {sql_r6("sqrt(coalesce(sum((l1 - value) ** 2), 0))")} AS cid_ce_normalize_false,
  {sql_r6("CASE WHEN any_value(sigma) > 0 THEN sqrt(coalesce(sum((l1 - value) ** 2), 0)) / any_value(sigma) ELSE 0 END")} AS cid_ce_normalize_true,
  {sql_r6("min(i) FILTER (value = hi) / any_value(n)")} AS first_location_of_maximum, {sql_r6("(max(i) FILTER (value = hi) + 1) / any_value(n)")} AS last_location_of_maximum,
  {sql_r6("min(i) FILTER (value = lo) / any_value(n)")} AS first_location_of_minimum, {sql_r6("(max(i) FILTER (value = lo) + 1) / any_value(n)")} AS last_location_of_minimum,
  {", ".join(f"{sql_r6(f'coalesce(avg(l{2 * k} * l{k} * value), 0)')} AS c3_lag_{k}, {sql_r6(f'coalesce(avg(l{2 * k} * l{2 * k} * l{k} - l{k} * value * value), 0)')} AS time_reversal_asymmetry_statistic_lag_{k}" for k in (1, 2, 3))},
  count(*) FILTER ((value > 0) <> (l1 > 0)) AS number_crossing_m_m_0_0,
  count(*) FILTER ((value > -1) <> (l1 > -1)) AS number_crossing_m_m_m1_0, count(*) FILTER ((value > 1) <> (l1 > 1)) AS number_crossing_m_m_1_0, {", ".join(_corridor_sql(i, a, b) for i, (a, b) in enumerate(_CORRIDORS))},
  {sql_r6("CASE WHEN any_value(n) > 1 THEN (max(value) FILTER (i = n - 1) - max(value) FILTER (i = 0)) / (any_value(n) - 1) END")} AS mean_change,
  {sql_r6("CASE WHEN any_value(n) > 2 THEN (max(value) FILTER (i = n - 1) - max(value) FILTER (i = n - 2) - max(value) FILTER (i = 1) + max(value) FILTER (i = 0)) / (2 * (any_value(n) - 2)) END")} AS mean_second_derivative_central
FROM j GROUP BY 1, 2""")
def extended_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(catalogue.difference_features(_day_pairs(spark, sf_dir), EXAMPLE, ORDER))


def _strike(sign: str, out: str) -> str:
    return (f"CAST(max(i - coalesce(last_no_{out}, -1)) AS BIGINT) AS longest_strike_{out}_mean")


@query(f"""{_DAY_PAIRS}, {_MOMENTS}, l AS (SELECT *,
  last_value(CASE WHEN NOT value > mu THEN i END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_no_above,
  last_value(CASE WHEN NOT value < mu THEN i END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_no_below,
  {", ".join(f"value > lag(value, {k}) OVER w AND value > lead(value, {k}) OVER w AS t{k}" for k in range(1, 51))}
  FROM m WINDOW w AS (PARTITION BY example_ts, series ORDER BY i))
SELECT example_ts, series, {_strike(">", "above")}, {_strike("<", "below")},
  {", ".join(f"count(*) FILTER ({' AND '.join(f't{k}' for k in range(1, n + 1))}) AS number_peaks_n_{n}" for n in (1, 3, 5, 10, 50))}
FROM l GROUP BY 1, 2""")
def extended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(catalogue.run_features(_day_pairs(spark, sf_dir), EXAMPLE, ORDER))


_LAGS, _MASSES = range(10), [round(0.1 * q, 1) for q in range(1, 10)]
_SEGMENT = "CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END"
_BIN = "CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 10)), 9) ELSE 0 END"
_SHARES = [f"avg(CASE WHEN bin = {b} THEN 1.0 ELSE 0.0 END)" for b in range(10)]


def _trend_sql(y: str, x: str, name: str) -> str:
    """Least squares of y on x: slope, intercept, correlation, error of the slope."""
    spread = f"stddev_pop({y}) * stddev_pop({x})"
    r = f"CASE WHEN {spread} > 0 THEN covar_pop({y}, {x}) / ({spread}) END"
    error = f"sqrt(greatest(1 - coalesce({r}, 0) ** 2, 0) * var_pop({y}) / var_pop({x}) / (count(*) - 2))"
    return (f"CASE WHEN count(*) > 1 THEN regr_slope({y}, {x}) END AS {name}_slope, CASE WHEN count(*) > 1 THEN regr_intercept({y}, {x}) END AS {name}_intercept, "
            f"CASE WHEN count(*) > 1 THEN {r} END AS {name}_rvalue, CASE WHEN count(*) = 2 THEN 0.0 WHEN count(*) > 2 THEN {error} END AS {name}_stderr")


_TREND = ("slope", "intercept", "rvalue", "stderr")
_CHUNKS = [(c, f) for c in (5, 10, 50) for f in ("mean", "max", "min", "var")]
# autocovariances of all lags up to 40 as a list, the lag 0 first
_COVARIANCES = """cov AS (SELECT example_ts, series, any_value(n) AS n, any_value(hi) > any_value(lo) AS varies, list(c ORDER BY k) AS c FROM (
  SELECT a.example_ts, a.series, b.i - a.i AS k, any_value(a.n) AS n, any_value(a.hi) AS hi, any_value(a.lo) AS lo, sum((a.value - a.mu) * (b.value - b.mu)) / count(*) AS c
  FROM m a JOIN m b ON b.example_ts = a.example_ts AND b.series = a.series AND b.i BETWEEN a.i AND a.i + 40 GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(f"""{_DAY_PAIRS}, {_MOMENTS}, l AS (SELECT *, {_SEGMENT} AS seg, {_BIN} AS bin,
  sum(abs(value)) OVER (PARTITION BY example_ts, series ORDER BY i ROWS UNBOUNDED PRECEDING) AS mass, sum(abs(value)) OVER (PARTITION BY example_ts, series) AS full_mass,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY example_ts, series)) / 3600e6 AS hours FROM m),
g AS (SELECT example_ts, series, {_trend_sql("value", "CAST(i AS DOUBLE)", "linear_trend")}, {_trend_sql("value", "hours", "linear_trend_timewise")},
  {", ".join(f"CASE WHEN sum(value * value) > 0 THEN coalesce(sum(value * value) FILTER (seg = {s}), 0) / sum(value * value) END AS energy_ratio_by_chunks_num_10_focus_{s}" for s in range(10))},
  {", ".join(f"(min(i) FILTER (mass >= {q} * full_mass) + 1) / any_value(n) AS index_mass_quantile_q_{str(q).replace('.', '_')}" for q in _MASSES)},
  -({" + ".join(f"CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END" for p in _SHARES)}) AS binned_entropy FROM l GROUP BY 1, 2),
{", ".join(f"""t{c} AS (SELECT example_ts, series, {", ".join(_trend_sql(f, "chunk", f"agg_linear_trend_f_agg_{f}_chunk_len_{c}") for f in ("mean", "max", "min", "var"))}
  FROM (SELECT example_ts, series, CAST(i // {c} AS DOUBLE) AS chunk, avg(value) AS mean, max(value) AS max, min(value) AS min, var_pop(value) AS var FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)""" for c in (5, 10, 50))},
{_COVARIANCES}, r AS (SELECT example_ts, series, CASE WHEN varies THEN list_transform(c, lambda x: x / c[1]) ELSE [] END AS r FROM cov),
a AS (SELECT example_ts, series, {", ".join(f"r[{k + 1}] AS ac{k}" for k in _LAGS)}, list_avg(r[2:41]) AS am, list_median(r[2:41]) AS ad, list_var_pop(r[2:41]) AS av FROM r)
SELECT g.example_ts, g.series, {", ".join(f"{sql_r6(f'ac{k}')} AS autocorrelation_lag_{k}" for k in _LAGS)},
  {", ".join(f"{sql_r6(c)} AS {c}" for c in (
    *[f"{a}_{s}" for a in ("linear_trend", "linear_trend_timewise") for s in _TREND],
    *[f"energy_ratio_by_chunks_num_10_focus_{s}" for s in range(10)], *[f"index_mass_quantile_q_0_{q}" for q in range(1, 10)], "binned_entropy",
    *[f"agg_linear_trend_f_agg_{f}_chunk_len_{c}_{s}" for c, f in _CHUNKS for s in _TREND]))},
  {sql_r6('am')} AS agg_autocorrelation_f_agg_mean_maxlag_40, {sql_r6('ad')} AS agg_autocorrelation_f_agg_median_maxlag_40, {sql_r6('av')} AS agg_autocorrelation_f_agg_var_maxlag_40
FROM g {" ".join(f"JOIN {x} ON {x}.example_ts = g.example_ts AND {x}.series = g.series" for x in ("t5", "t10", "t50", "a"))}""")
def extended_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(catalogue.trend_features(_day_pairs(spark, sf_dir), EXAMPLE, ORDER))


# Fourier sums by definition; Durbin-Levinson and the elimination of the normal equations as recursions over lists.
_PARTS = "CASE WHEN abs({0}) <= 1e-9 * total THEN 0.0 ELSE {0} END"
_WEIGHTS = [f"sum(k ** {p} * w) / sum(w)" for p in range(5)]
_VECTORS_SQL = f"""{_DAY_PAIRS}, {_MOMENTS},
f0 AS (SELECT example_ts, series, k, sum(value * cos(2 * pi() * k * i / n)) AS re, -sum(value * sin(2 * pi() * k * i / n)) AS im, sum(abs(value)) AS total
  FROM (SELECT *, unnest(generate_series(0, n // 2)) AS k FROM m) GROUP BY 1, 2, 3),
f1 AS (SELECT example_ts, series, k, {_PARTS.format("re")} AS re, {_PARTS.format("im")} AS im FROM f0),
f AS (SELECT *, sqrt(re * re + im * im) AS w, atan2(im, re) * 180 / pi() AS angle FROM f1),
s AS (SELECT example_ts, series, {", ".join(f"max({c}) FILTER (k = {k}) AS fft_coefficient_attr_{a}_coeff_{k}" for k in range(100) for a, c in (("real", "re"), ("imag", "im"), ("abs", "w"), ("angle", "angle")))},
  {", ".join(f"CASE WHEN sum(w) > 0 THEN {x} END AS w{p}" for p, x in enumerate(_WEIGHTS))} FROM f GROUP BY 1, 2),
s1 AS (SELECT *, w2 - w1 * w1 AS v FROM s),
{_COVARIANCES},
d AS (SELECT example_ts, series, 1 AS k, least(9, n - 2) AS most, c, [1.0::DOUBLE] AS found, []::DOUBLE[] AS phi, c[1] AS error FROM cov WHERE varies AND n >= 3
  UNION ALL SELECT example_ts, series, k + 1, most, c, list_append(found, r), list_append(list_transform(range(1, k), lambda j: phi[j] - r * phi[k - j]), r), error * (1 - r * r)
  FROM (SELECT *, (c[k + 1] - coalesce(list_sum(list_transform(range(1, k), lambda j: phi[j] * c[k + 1 - j])), 0)) / error AS r FROM d WHERE k <= most AND error > 0)),
p AS (SELECT example_ts, series, arg_max(found, k) AS found FROM d GROUP BY 1, 2),
z AS (SELECT example_ts, series, n, list(value) OVER (PARTITION BY example_ts, series ORDER BY i ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS y, i FROM m),
z1 AS (SELECT example_ts, series, list_concat([1.0], list_reverse(y[1:10]), [y[11]]) AS y FROM z WHERE n >= 22 AND i >= 10),
z2 AS (SELECT example_ts, series, a, b, sum(y[a] * y[b]) AS q FROM (SELECT *, unnest(range(1, 13)) AS b FROM (SELECT *, unnest(range(1, 12)) AS a FROM z1)) GROUP BY 1, 2, 3, 4),
elim AS (SELECT example_ts, series, 0 AS k, list(q ORDER BY a, b) AS x FROM z2 GROUP BY 1, 2
  UNION ALL SELECT example_ts, series, k + 1, list_transform(range(0, 132), lambda j: CASE WHEN j // 12 = k THEN x[j + 1] / x[13 * k + 1]
    ELSE x[j + 1] - x[12 * (j // 12) + k + 1] * x[12 * k + j % 12 + 1] / x[13 * k + 1] END) FROM elim WHERE k < 11)
SELECT s1.example_ts, s1.series, {", ".join(f"{sql_r6(f's1.fft_coefficient_attr_{a}_coeff_{k}')} AS fft_coefficient_attr_{a}_coeff_{k}" for k in range(100) for a in ("real", "imag", "abs", "angle"))},
  {sql_r6("w1")} AS fft_aggregated_aggtype_centroid, {sql_r6("v")} AS fft_aggregated_aggtype_variance,
  {sql_r6("CASE WHEN v >= 0.5 THEN (w3 - 3 * w1 * v - w1 ** 3) / v ** 1.5 END")} AS fft_aggregated_aggtype_skew,
  {sql_r6("CASE WHEN v >= 0.5 THEN (w4 - 4 * w1 * w3 + 6 * w2 * w1 ** 2 - 3 * w1 ** 4) / v ** 2 END")} AS fft_aggregated_aggtype_kurtosis,
  {", ".join(f"{sql_r6(f'elim.x[{12 * k + 12}]')} AS ar_coefficient_k_10_coeff_{k}" for k in range(11))},
  {", ".join(f"{sql_r6(f'p.found[{k + 1}]')} AS partial_autocorrelation_lag_{k}" for k in range(10))}
FROM s1 LEFT JOIN p ON p.example_ts = s1.example_ts AND p.series = s1.series LEFT JOIN elim ON elim.example_ts = s1.example_ts AND elim.series = s1.series AND elim.k = 11"""


@query(_VECTORS_SQL)
def extended_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourier coefficients, autoregression and partial autocorrelation of every window."""
    return _shown(catalogue.vector_features(_day_pairs(spark, sf_dir), EXAMPLE, ORDER))


def _side_by_side(*statements: str) -> str:
    """Rows of all statements joined by window."""
    joins = "".join(f" JOIN ({sql}) q{i} ON q{i}.example_ts = q0.example_ts AND q{i}.series = q0.series" for i, sql in enumerate(statements) if i)
    shown = ", ".join(["q0.*", *[f"q{i}.* EXCLUDE (example_ts, series)" for i in range(1, len(statements))]])
    return f"SELECT {shown} FROM ({statements[0]}) q0{joins}"


@query(_side_by_side(f"{_DAY_PAIRS} SELECT example_ts, series, {_MINIMAL_LIST} FROM pairs GROUP BY 1, 2", ORACLES["extended_plain"], _duplicates_sql("value"),
                     ORACLES["extended_differences"], ORACLES["extended_runs"], ORACLES["extended_trends"], _VECTORS_SQL))
def efficient_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extended set of every window: one row per error and series."""
    return _shown(catalogue.efficient_features(settle(_day_pairs(spark, sf_dir), "window-samples"), EXAMPLE, ORDER))

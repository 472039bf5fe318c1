"""The failure-prediction job from a global frame to scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions.names import col, columns_of, pick
from faultline.functions.times import epoch_us
from faultline.operators import catalogue, cleansing, encode, features, fill, labels, resample, timeline, windows
from faultline.operators.sampling import class_counts
from faultline.params import Horizon, PredictionParams
from faultline.plans import evaluation
from faultline.session import settle, settled_tables
from faultline.sources import dumps, files, raw_json, stores

KEYS = ("machine_id",)
_SLOTS = 16


def extract(spark: SparkSession, paths: str | Sequence[str], machine_id: str, valid: Sequence[str] = timeline.MACHINE_IDS,
            keep_before_damage: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw dumps -> (samples of one machine, quarantine): S2-S4, S10, R1-R4, R7. Every file is read once.

    The quarantine holds ``source_file``, ``text`` and ``reason``. A file that ends early or is damaged is set aside as a whole,
    with a null text; with ``keep_before_damage`` its objects before the damage are used, and an object stays good when other
    text follows it. Fields outside ``raw_json.RECORD_SCHEMA`` aren't read here (``raw_json.flatten_objects`` reads them).
    """
    rows = settle(dumps.read_dumps(spark, paths, strict=not keep_before_damage), "objects")
    damaged = settle(rows.filter("text IS NULL").select("source_file", "text", F.col("problem").alias("reason")), "damaged-files")
    if not keep_before_damage:
        rows = rows.join(damaged.select("source_file"), "source_file", "left_anti")
    records, bad = raw_json.parse_records(rows.filter("problem IS NULL").drop("problem", "position"), cut=True)
    faulty = rows.filter("problem IS NOT NULL AND text IS NOT NULL").select("source_file", "text", F.col("problem").alias("reason"))
    bad = bad.select("source_file", "text", F.lit("no record").alias("reason")).unionByName(faulty).unionByName(damaged)
    named = records.withColumn("machineId", F.col("record.machineId"))
    own = timeline.single_machine(named, machine_id, "machineId", valid)
    items = raw_json.component_items(own, keep=["source_file"])
    samples = raw_json.field_samples(items, keep=["source_file"])
    return timeline.latest_wins(samples, ["machine_id", "series", "ts"], "seq", ["source_file"]), bad


def global_frame(samples: DataFrame) -> DataFrame:
    """Numbers and states of all series side by side."""
    samples = settle(samples, "samples")
    numbers = samples.filter(F.col("num_value").isNotNull())
    states = samples.filter(F.col("str_value").isNotNull())
    parts = [timeline.widen(part, value, names) for part, value in ((numbers, "num_value"), (states, "str_value"))
             if (names := timeline.series_names(part))]
    line = timeline.timeline(samples)
    for part in parts:
        line = line.join(part, [*KEYS, "ts"], "left")
    return line


def cleanse(df: DataFrame, p: PredictionParams) -> DataFrame:
    """C1-C15 in the job's order; written once per stage that is read several times."""
    df = fill.normalise_missing(df, [*KEYS, "ts"])
    df = settle(cleansing.drop_constant_columns(df, keep=[*KEYS, "ts", p.target_col]), "filtered")
    values = [c for c in df.columns if c not in (*KEYS, "ts")]
    df = settle(resample.resample_last(df, p.sampling_seconds, values, KEYS), "resampled")
    df = settle(fill.impute(df, p.string_fill, p.numeric_fill, p.replace_extreme, keys=KEYS), "imputed")
    return fill.slice_valid(df, values, keys=KEYS)


@dataclass(frozen=True)
class WindowInput:
    """What reading windows are cut from, in long form.

    ``numbers`` holds (machine_id, ts, series, value); ``present`` one row per category that holds at a
    time (C14, sparse); ``names`` all categories as a table (series); ``times`` the rows of the cleansed frame.
    """

    numbers: DataFrame
    present: DataFrame | None
    names: DataFrame | None
    times: DataFrame


def window_input(df: DataFrame, p: PredictionParams) -> WindowInput:
    """Cleansed frame in long form; the target code stays a number, other codes and text become categories."""
    numbers = [*columns_of(df, "numeric", exclude=[*KEYS, "ts"]), *([p.target_col] if p.target_col in df.columns else [])]
    long = settle(windows.unpivot_numeric(df, numbers, [*KEYS, "ts"]), "numbers")
    times = settle(df.select(*pick(KEYS), "ts"), "times")
    categories = encode.category_columns(df, p.target_col, [*KEYS, "ts"])
    if not categories:
        return WindowInput(long, None, None, times)
    present = settle(encode.one_hot_long(df, categories, [*KEYS, "ts"]).select(*pick(KEYS), "ts", "series"), "categories")
    return WindowInput(long, present, settle(encode.level_names(present), "category-names"), times)


def example_features(given: WindowInput, examples: DataFrame, horizon: Horizon, minimal: bool = True) -> DataFrame:
    """F10-F13 for a set of examples: long (machine_id, ts, code, window bounds, feature, value).

    Numbers are aggregated over the joined samples; the extended features (F12), unless ``minimal``, come from the same
    samples. Categories need only counts: how many rows the window has and in how many of them the category holds.
    Every window gets every category; the names are dealt to the windows by an equi-join on hash slots.
    """
    bounded = windows.with_windows(examples, horizon)
    by = [*KEYS, "example_ts", "code", "window_start", "window_end", "window_length"]
    pairs = windows.window_samples(given.numbers, bounded, horizon.rw)
    made = features.minimal_features(pairs, [*by, "series"])
    if given.present is not None:
        rows = windows.samples_used(given.times, bounded, horizon.rw)
        ones = windows.window_samples(given.present, bounded, horizon.rw).groupBy(*pick(by), "series").agg(F.count(F.lit(1)).alias("ones"))
        slots = F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1)))
        every = rows.withColumn("__slot", slots).join(given.names.withColumn("__slot", F.pmod(F.xxhash64("series"), F.lit(_SLOTS)).cast("int")), "__slot").drop("__slot")
        counts = every.join(ones, [*by, "series"], "left").withColumnRenamed("samples_used", "n")
        made = made.unionByName(features.indicator_features(counts))
    long = features.features_long(made, [*by, "series"])
    if not minimal:
        more = catalogue.efficient_features(settle(pairs, "window-samples"), [*by, "series"])
        names = [c for c in more.columns if c not in (*by, "series", *features.MINIMAL)]
        cells = F.explode(F.array(*[F.struct(F.concat_ws("__", "series", F.lit(n)).alias("feature"), col(n).cast("double").alias("value")) for n in names]))
        long = long.unionByName(more.select(*pick(by), cells.alias("c")).select(*pick(by), "c.*").filter("value IS NOT NULL AND NOT isnan(value)").select(long.columns))
    return long.withColumnRenamed("example_ts", "ts")


def examples_for(codes: DataFrame, p: PredictionParams, store: DataFrame | None = None) -> DataFrame:
    """All positives and enough random negatives, leaving out what the store holds."""
    seed = p.seeds[0]
    positives = settle(labels.positive_examples(codes, p.target_code, p.horizon), "positives")
    negatives = labels.negative_candidates(codes, p.target_code, p.horizon)
    held = 0
    fresh = positives
    if store is not None:
        fresh = labels.not_processed(positives, store.filter(F.col("code") == p.target_code), [*KEYS, "ts"])
        old = store.filter(F.col("code") != p.target_code).select(*pick(KEYS), "ts").distinct()
        negatives, held = labels.not_processed(negatives, old, [*KEYS, "ts"]), old.count()
    drawn = labels.balanced_negatives(positives, negatives, p.balance_ratio, seed, held)
    columns = [*KEYS, "ts", "code"]
    return fresh.select(*pick(columns)).unionByName(drawn.select(*pick(columns)))


def store_examples(given: WindowInput, codes: DataFrame, p: PredictionParams, path: str) -> None:
    """features of the positives that the store lacks, and of as many negatives per iteration, for every stored horizon.

    ``p.stored_per_iteration`` bounds the examples of a class; without it all positives are stored, and negatives
    to the balance of the run.
    """
    for horizon in p.stored_horizons:
        for positive in (True, False):
            if positive:
                found = labels.positive_examples(codes, p.target_code, horizon)
            else:
                found = labels.negative_candidates(codes, p.target_code, horizon)
            done = stores.stored_examples(codes.sparkSession, path, p.target_code, horizon, positive)
            if done is not None:
                found = labels.not_processed(found, done, [*KEYS, "ts"])
            if p.stored_per_iteration is not None:
                drawn = labels.sample_examples(found, p.stored_per_iteration * (1 if positive else p.stored_iterations), p.seeds[0])
            elif positive:
                drawn = found
            else:
                positives = labels.positive_examples(codes, p.target_code, horizon)
                drawn = labels.sample_examples(found, p.stored_iterations * labels.negatives_needed(positives.count(), p.balance_ratio), p.seeds[0])
            made = example_features(given, drawn.select(*pick(KEYS), "ts", "code"), horizon, p.minimal_features)
            stores.append_examples(made, path, p.target_code, horizon, positive)


def stored_for_balance(stored: DataFrame, codes: DataFrame, p: PredictionParams) -> DataFrame:
    """F16: of the store all positives, and of its negatives no more than the balance of the run needs, drawn by the seed."""
    hit = F.col("code") == F.lit(p.target_code)
    needed = labels.negatives_needed(labels.positive_examples(codes, p.target_code, p.horizon).count(), p.balance_ratio)
    chosen = labels.sample_examples(stored.filter(~hit).select(*pick(KEYS), "ts").distinct(), needed, p.seeds[0])
    return stored.filter(hit).unionByName(stored.filter(~hit).join(chosen, [*KEYS, "ts"], "left_semi").select(stored.columns))


def incomplete_examples(long: DataFrame) -> DataFrame:
    """Examples that lack a feature and therefore stay out of :func:`matrix`, with the number they have."""
    width = settle(features.feature_index(long), "feature-index").count()
    return long.groupBy(*pick([*KEYS, "ts", "code"])).agg(F.count_distinct("feature").alias("n_features")).filter(F.col("n_features") < width)


def matrix(long: DataFrame, p: PredictionParams) -> DataFrame:
    """Features scaled by ``p.scaler``, without count-like ones, as (id, label, x).

    An example that lacks a feature is left out, as rows with missing values are (:func:`incomplete_examples` lists them).
    """
    kept = settle(features.drop_count_features(long), "features")
    scaled = kept if p.fit_scaler_per_fold else features.scale_long(kept, p.scaler)
    index = settle(features.feature_index(kept), "feature-index")
    width = index.count()
    by = [*KEYS, "ts", "code"]
    cells = F.array_sort(F.collect_list(F.struct("position", "value")))
    rows = scaled.join(index, "feature").groupBy(*pick(by)).agg(cells.alias("cells")).filter(F.size("cells") == width)
    labelled = features.with_label(rows, "code", p.target_code)
    identity = F.pmod(F.xxhash64(*pick(KEYS), epoch_us(col("ts"))), F.lit(1 << 62))
    return labelled.select(identity.alias("id"), "label", F.transform("cells", lambda c: c["value"]).alias("x"))


def run(frame: DataFrame, p: PredictionParams, results_path: str | None = None, store_path: str | None = None) -> DataFrame:
    """C1-C15, F1-F19, M1-M10 on a global frame: a summary row per seed; with an ensemble also one for its vote and each member.

    The summary's few rows are held by the session, and the tables that the job has settled are removed at its end.
    """
    with settled_tables():
        summary = _run(frame, p, results_path, store_path)
        return frame.sparkSession.createDataFrame(summary.collect(), summary.schema)


def _run(frame: DataFrame, p: PredictionParams, results_path: str | None = None, store_path: str | None = None) -> DataFrame:
    codes = settle(labels.code_series(frame, p.target_col).filter(F.col("code").isNotNull()), "codes")
    given = window_input(cleanse(frame, p), p)
    stored = None
    if store_path and p.store_examples:
        store_examples(given, codes, p, store_path)
    if store_path:
        held = [s for s in (stores.stored_examples(frame.sparkSession, store_path, p.target_code, p.horizon, kind) for kind in (True, False)) if s is not None]
        stored = held[0].unionByName(held[1]) if held else None
    if stored is not None:
        stored = settle(stored_for_balance(stored, codes, p), "stored")
    long = example_features(given, examples_for(codes, p, stored), p.horizon, p.minimal_features)
    if stored is not None:
        long = long.unionByName(stored.select(*pick(long.columns)))
    rows = settle(matrix(long, p), "matrix")
    counts = class_counts(rows)
    if len(counts) < 2:
        raise ValueError(f"both classes are needed, got {counts}")
    summary = evaluated(rows, p)
    if results_path:
        stores.append_results(summary, results_path, target_code=p.target_code, pw=p.horizon.pw, rw=p.horizon.rw,
                              classifier=p.classifier, oversampling=str(p.oversampling), balance_ratio=p.balance_ratio,
                              sampling_percentage=p.sampling_percentage, folds=p.folds)
    return summary


def evaluated(rows: DataFrame, p: PredictionParams) -> DataFrame:
    """M4, M7-M10 on an example matrix: a summary row per seed, with an ensemble also one for its vote and each member."""
    summary = evaluation.evaluate(rows, p.target_code, p.classifier, p.sampling_percentage, p.seeds, p.folds,
                                  oversampling=p.oversampling, evaluate_all_data=p.evaluate_all_data,
                                  fit_scaler_per_fold=p.fit_scaler_per_fold, classifier_options=p.classifier_options)
    if p.ensemble:
        voted, single = evaluation.evaluate_ensemble(rows, p.target_code, p.ensemble, p.ensemble_seeds, p.folds, p.voting)
        voted = voted.withColumn("member", F.lit(f"{p.voting} vote"))
        summary = settle(summary.unionByName(voted.unionByName(single, allowMissingColumns=True), allowMissingColumns=True), "summary")
    return summary


def run_from_files(spark: SparkSession, paths: Sequence[str], p: PredictionParams, sample_size: int | None = None, seed: int = 0) -> DataFrame:
    """S8, S9, R12, R13 in front of :func:`run`: Parquet files of the buffer, common columns only."""
    if sample_size is not None:
        listed = spark.createDataFrame([(f,) for f in paths], "path string")
        paths = [r[0] for r in files.sample_files(listed, sample_size, seed).collect()]
    df = spark.read.parquet(*paths)
    place = df.select(*pick(files.common_columns(spark, paths)), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    once = timeline.first_per_timestamp(place, ["__file", "__row"], [*KEYS, "ts"]).drop("__file", "__row")
    return run(timeline.objects_to_text(once, exclude=[*KEYS, "ts"]), p)

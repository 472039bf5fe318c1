"""Error runs, itemsets before errors, frequent itemsets and rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from faultline.functions.names import col, is_error_code, pick
from faultline.functions.times import MICROS, epoch_us, shift
from faultline.operators.fill import forward_fill, slice_valid
from faultline.operators.ordered import SLOT_SECONDS, scan
from faultline.operators.windows import interval_join
from faultline.params import OK_CODE, MiningParams
from faultline.session import settle


def prepare(df: DataFrame, keys: Sequence[str] = ("source_file",), ts: str = "ts", slot_seconds: float = SLOT_SECONDS) -> DataFrame:
    """Per file the error-code columns, forward-filled, from the point where all are known.

    A column that is empty in one file takes no part in that file's start.
    """
    codes = [c for c in df.columns if is_error_code(c)]
    filled = forward_fill(df.select(*pick(keys), col(ts), *pick(codes)), codes, keys, ts, slot_seconds=slot_seconds)
    return slice_valid(filled, codes, True, keys, ts)


def run_boundaries(
    df: DataFrame, code: str, keys: Sequence[str], ts: str, tie: Sequence[str] = (), slot_seconds: float = SLOT_SECONDS
) -> DataFrame:
    """Rows with the codes just before and just after them."""
    known = F.struct(col(code).alias("c"))
    return scan(df.select(*pick(keys), col(ts), *pick(tie), col(code)), keys, ts, tie,
                before={"__prev": known}, after={"__next": known}, slot_seconds=slot_seconds)


def error_runs(
    df: DataFrame, code: str = "code", keys: Sequence[str] = ("source_file",), ts: str = "ts",
    tie: Sequence[str] = (), slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """[run_start, run_end] of every maximal run of rows with the same code, without the OK code.

    Rows that open or close a run are found with one scan; the end of a run is then the next
    closing row, looked up among boundary rows only.
    """
    edges = run_boundaries(df, code, keys, ts, tie, slot_seconds)
    opens = ~col("__prev")["c"].eqNullSafe(col(code))
    closes = ~col("__next")["c"].eqNullSafe(col(code))
    marked = edges.select(*pick(keys), col(ts), *pick(tie), col(code), opens.alias("opens"), closes.alias("closes")).filter(
        (F.col("opens") | F.col("closes")) & col(code).isNotNull() & (col(code) != F.lit(OK_CODE))
    )
    ended = scan(settle(marked, "run-edges"), keys, ts, tie,
                 next={"run_end": F.when(F.col("closes"), col(ts))}, slot_seconds=slot_seconds)
    return ended.filter("opens").select(*pick(keys), col(code), col(ts).alias("run_start"), "run_end")


def with_previous_end(
    runs: DataFrame, code: str = "code", keys: Sequence[str] = ("source_file",), slot_seconds: float = 24 * SLOT_SECONDS
) -> DataFrame:
    """The end of the same code's previous run."""
    return scan(runs, [*keys, code], "run_start", before={"prev_end": F.col("run_end")}, slot_seconds=slot_seconds)


def spaced_runs(runs: DataFrame, min_gap: int, code: str = "code", keys: Sequence[str] = ("source_file",)) -> DataFrame:
    """A code's first run, and later ones more than ``min_gap`` seconds after the previous end.

    The whole distance counts, also beyond one day.
    """
    gap_us = epoch_us(F.col("run_start")) - epoch_us(F.col("prev_end"))
    return with_previous_end(runs, code, keys).filter(F.col("prev_end").isNull() | (gap_us > F.lit(int(min_gap * MICROS))))


def run_windows(
    df: DataFrame, runs: DataFrame, window_len: int, keys: Sequence[str] = ("source_file",), ts: str = "ts",
) -> DataFrame:
    """P5: rows in ``[run_start - window_len, run_start)`` paired with their run."""
    intervals = runs.select(*pick(keys), F.col("code").alias("error_code"), F.col("run_start"),
                            shift(F.col("run_start"), -window_len).alias("window_start"))
    return interval_join(df, intervals, keys, ts, "window_start", "run_start", window_len, high_inclusive=False)


def itemsets(
    df: DataFrame, runs: DataFrame, window_len: int, min_obs: int, columns: Sequence[str],
    keys: Sequence[str] = ("source_file",), ts: str = "ts",
) -> DataFrame:
    """P5 + P6: per window with more than ``min_obs`` rows the sorted distinct codes without OK.

    ``columns`` is the target column alone or all error columns. Windows without any code
    keep their empty set: they count in the denominator. Both aggregates combine in the join's
    own stage, so what is shuffled is windows and their codes, not pairs.
    """
    codes = F.array(*[col(c).cast("int") for c in columns])
    rows = df.select(*pick(keys), col(ts), F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != OK_CODE))).alias("__codes"))
    pairs = run_windows(rows, runs, window_len, keys, ts)
    group = [*keys, "error_code", "run_start"]
    windows = pairs.groupBy(*pick(group), "__codes").agg(F.count(F.lit(1)).alias("__n"))
    merged = windows.groupBy(*pick(group)).agg(
        F.sum("__n").alias("n_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__codes")))).alias("items"),
    )
    return merged.filter(F.col("n_rows") > min_obs)


def window_counts(windows: DataFrame, support: float) -> DataFrame:
    """Per code with at least two windows: their number and the support threshold."""
    return (
        windows.groupBy("error_code").agg(F.count(F.lit(1)).alias("n_windows"))
        .filter("n_windows >= 2")
        .withColumn("min_support", F.ceil(F.col("n_windows") * F.lit(support)))
    )


def frequent_itemsets(windows: DataFrame, support: float) -> DataFrame:
    """Itemsets per error code that occur in at least ``ceil(windows * support)`` windows.

    All codes are mined together: an item is prefixed with its window's code, so itemsets
    cannot mix codes. Items too rare for their own code are removed first (no frequent set contains
    them). Codes whose thresholds lie within a factor of two share one FP-growth run, so that a code
    with two windows does not force a support of one on a code with millions.
    """
    spark = windows.sparkSession
    windows = settle(windows.select("error_code", "items").withColumn("wid", F.monotonically_increasing_id()), "windows")
    counts = window_counts(windows, support)
    exploded = windows.join(counts, "error_code").select("error_code", "wid", "min_support", "n_windows", F.explode("items").alias("item"))
    common = (
        exploded.groupBy("error_code", "item", "min_support").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.col("min_support")).select("error_code", "item")
    )
    baskets = settle(
        exploded.join(common, ["error_code", "item"])
        .withColumn("class", F.floor(F.log2(F.greatest(F.col("min_support"), F.lit(1)))).cast("int"))
        .groupBy("error_code", "wid", "class")
        .agg(F.collect_set(F.concat_ws("|", "error_code", "item")).alias("items")),
        "baskets",
    )
    result = spark.createDataFrame([], "error_code bigint, n_windows bigint, itemset array<int>, support bigint, support_rel double")
    sizes = {r["class"]: r["n"] for r in baskets.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    for level, size in sorted(sizes.items()):
        part = baskets.filter(F.col("class") == level)
        fitted = FPGrowth(itemsCol="items", minSupport=max((2 ** level - 0.5) / size, 0.0), minConfidence=1.0).fit(part)
        split = fitted.freqItemsets.select(
            F.split(F.element_at("items", 1), r"\|")[0].cast("bigint").alias("error_code"),
            F.array_sort(F.transform("items", lambda i: F.split(i, r"\|")[1].cast("int"))).alias("itemset"),
            F.col("freq").alias("support"),
        )
        found = split.join(counts, "error_code").filter(F.col("support") >= F.col("min_support")).select(
            "error_code", "n_windows", "itemset", "support", (F.col("support") / F.col("n_windows")).alias("support_rel")
        )
        result = result.unionByName(found)
    return result


def association_rules(frequent: DataFrame, confidence: float) -> DataFrame:
    """Every split of a frequent itemset into antecedent and consequent with enough confidence.

    Consequents grow by one item a level, always by a larger one, so that each is made once. Moving an item from the antecedent
    to the consequent can only lower the confidence: what fails is not extended, and nothing is missed. Supports of
    antecedents are looked up by equality; a subset of a frequent set is itself frequent.
    """
    base = frequent.select("error_code", F.col("itemset").alias("antecedent"), F.col("support").alias("base"))
    made = frequent.filter(F.size("itemset") > 1).select("error_code", "itemset", "support", F.explode("itemset").alias("item")).withColumn("consequent", F.array("item"))
    found = []
    while True:
        split = made.withColumn("antecedent", F.array_except("itemset", "consequent"))
        looked = split.join(base, ["error_code", "antecedent"]).withColumn("confidence", F.col("support") / F.col("base"))
        level = settle(looked.filter(F.col("confidence") >= confidence).select("error_code", "itemset", "support", "antecedent", "consequent", "confidence"), "rules")
        found.append(level.select("error_code", "antecedent", "consequent", "confidence"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        larger = F.filter("itemset", lambda x: x > F.element_at("consequent", -1))
        made = (level.filter(F.size("consequent") < F.size("itemset") - 1).select("error_code", "itemset", "support", "consequent", F.explode(larger).alias("item"))
                .withColumn("consequent", F.concat("consequent", F.array("item"))))


def mine(df: DataFrame, params: MiningParams, keys: Sequence[str] = ("source_file",), ts: str = "ts", slot_seconds: float = SLOT_SECONDS) -> tuple[DataFrame, DataFrame]:
    """P1-P10 over all files at once: (frequent itemsets, rules)."""
    ready = settle(prepare(df, keys, ts, slot_seconds), "prepared")
    codes = [c for c in ready.columns if is_error_code(c)]
    as_code = ready.withColumn("code", col(params.target_col).cast("bigint"))
    runs = spaced_runs(settle(error_runs(as_code, "code", keys, ts, slot_seconds=slot_seconds), "runs"), params.min_gap, "code", keys)
    used = codes if params.cross_component else [params.target_col]
    windows = itemsets(ready, runs, params.window_len, params.min_obs, used, keys, ts)
    frequent = settle(frequent_itemsets(windows, params.support), "itemsets")
    return frequent, association_rules(frequent, params.confidence)

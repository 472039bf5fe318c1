"""Target codes, runs, and the examples to predict."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.names import col, pick
from faultline.functions.times import MICROS, epoch_us, from_epoch_us
from faultline.operators.ordered import SLOT_SECONDS, asof, scan
from faultline.operators.ranks import keep_first
from faultline.params import OK_CODE, Horizon
from faultline.session import settle

FOLD_LIMIT = 4096  # errors of one segment that are folded in a single row


def code_series(df: DataFrame, target_col: str, keys: Sequence[str] = ("machine_id",), ts: str = "ts") -> DataFrame:
    """the target code column with its keys."""
    return df.select(*pick(keys), col(ts), col(target_col).alias("code"))


def consecutive(
    df: DataFrame,
    column: str,
    code: int,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """running count of consecutive rows with ``code`` and with the OK code, 0 elsewhere.

    The count is the distance to the newest row without the code, so a single scan serves both.
    """
    hit = {c: F.coalesce(col(column).cast("bigint") == F.lit(c), F.lit(False)) for c in (code, OK_CODE)}
    looked = scan(
        df, keys, ts, tie, position="__pos", slot_seconds=slot_seconds,
        last={f"__other{i}": F.when(~h, F.col("__pos")) for i, h in enumerate(hit.values())},
    )
    runs = [
        F.when(hit[c], F.col("__pos") - F.coalesce(F.col(f"__other{i}"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
        .alias(f"{column}.{c}.consecutiveErrors")
        for i, c in enumerate(hit)
    ]
    return looked.select(*pick(df.columns), *runs)


def positive_examples(
    codes: DataFrame,
    target: int,
    horizon: Horizon,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    code: str = "code",
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """errors with the target code, thinned greedily: one is kept only if the last kept one is
    more than PW+RW older.

    Greedy thinning is sequential, but no decision crosses a stretch of PW+RW without errors.
    Time is cut into cells of that length; maximal runs of occupied cells are independent
    segments. Short segments are folded in one row each. Segments above ``fold_limit`` errors
    (a machine that never stops failing) follow successor pointers with doubling steps instead,
    which reaches the same set with log2(kept errors) joins and no group to hold in memory.
    """
    gap_us = horizon.reach * MICROS
    errors = (
        codes.filter(col(code) == F.lit(target))
        .select(*pick(keys), epoch_us(col(ts)).alias("us"))
        .distinct()
        .withColumn("cell", (F.col("us") - F.pmod("us", F.lit(gap_us))) / F.lit(gap_us))
        .withColumn("cell", F.col("cell").cast("bigint"))
    )
    errors = settle(errors, "target-errors")
    along = Window.partitionBy(*pick(keys)).orderBy("cell")
    cells = (
        errors.groupBy(*pick(keys), "cell").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("segment", F.col("cell") - F.row_number().over(along))
    )
    sizes = cells.groupBy(*pick(keys), "segment").agg(F.sum("n").alias("size"))
    named = errors.join(cells.drop("n").join(sizes, [*keys, "segment"]), [*keys, "cell"])
    small = named.filter(F.col("size") <= fold_limit)
    folded = (
        small.groupBy(*pick(keys), "segment")
        .agg(F.aggregate(F.array_sort(F.collect_list("us")), F.array().cast("array<bigint>"),
                         lambda kept, t: F.when((F.size(kept) == 0) | (F.element_at(kept, -1) < t - F.lit(gap_us)),
                                                F.concat(kept, F.array(t))).otherwise(kept)).alias("kept"))
        .select(*pick(keys), F.explode("kept").alias("us"))
    )
    large = named.filter(F.col("size") > fold_limit)
    if not large.isEmpty():
        folded = folded.unionByName(_follow_pointers(settle(large, "dense-errors"), keys, gap_us))
    return folded.select(*pick(keys), from_epoch_us(F.col("us")).alias(ts), F.lit(target).alias(code))


def _follow_pointers(errors: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """Kept errors of long segments: the orbit of each segment's first error under "next error more
    than ``gap_us`` later", found by pointer doubling."""
    group = [*keys, "segment"]
    # The successor lies in the following cell (same offset or later), else it is the first of the one after.
    asked = errors.select(*pick(group), (F.col("cell") + 1).alias("cell"), (F.col("us") + F.lit(gap_us)).alias("at"),
                          F.col("us").alias("origin"), F.lit(1).alias("side"))
    known = errors.select(*pick(group), "cell", F.col("us").alias("at"), F.col("us").alias("error"), F.lit(0).alias("side"))
    later = Window.partitionBy(*pick(group), "cell").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    same_cell = (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn("in_cell", F.last("error", ignorenulls=True).over(later))
        .filter(F.col("origin").isNotNull())
    )
    firsts = errors.groupBy(*pick(group), (F.col("cell") - 1).alias("cell")).agg(F.min("us").alias("in_next"))
    jump = settle(
        same_cell.join(firsts, [*group, "cell"], "left")
        .select(*pick(group), F.col("origin").alias("us"), F.coalesce("in_cell", "in_next").alias("to")),
        "successors",
    )
    reached = settle(errors.groupBy(*pick(group)).agg(F.min("us").alias("us")), "reached")
    while True:
        step = reached.join(jump, [*group, "us"]).filter(F.col("to").isNotNull()).select(*pick(group), F.col("to").alias("us"))
        if step.isEmpty():
            return reached.select(*pick(keys), "us")
        reached = settle(reached.unionByName(step).distinct(), "reached")
        onward = jump.select(*pick(group), F.col("us").alias("to"), F.col("to").alias("onward"))
        jump = settle(
            jump.filter(F.col("to").isNotNull()).join(onward, [*group, "to"], "left")
            .select(*pick(group), "us", F.col("onward").alias("to")),
            "successors",
        )


def negative_candidates(
    codes: DataFrame,
    target: int,
    horizon: Horizon,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    code: str = "code",
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """F5 + F6: rows whose forward-filled code is another one and whose reading window holds no target error.

    A candidate *t* falls out when some target error lies in ``[t-PW-RW, t-PW]``, that is when
    the newest error at or before ``t-PW`` is not older than ``t-PW-RW``: an as-of lookup, so
    errors and candidates are never paired.
    """
    filled = scan(codes.select(*pick(keys), col(ts), col(code)), keys, ts, last={code: col(code)}, slot_seconds=slot_seconds)
    candidates = settle(filled.filter(col(code) != F.lit(target)), "candidates")
    errors = codes.filter(col(code) == F.lit(target)).select(*pick(keys), epoch_us(col(ts)).alias("__us"))
    return without_errors_in_window(candidates, errors, horizon, keys, ts, slot_seconds)


def without_errors_in_window(
    candidates: DataFrame,
    errors: DataFrame,
    horizon: Horizon,
    keys: Sequence[str] = ("machine_id",),
    ts: str = "ts",
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """F6 alone; ``errors`` holds (keys, __us)."""
    window_end = epoch_us(col(ts)) - F.lit(horizon.pw * MICROS)
    looked = asof(candidates, errors, keys, window_end, F.col("__us"), F.col("__us"), "__error_us", slot_seconds=slot_seconds)
    window_start = epoch_us(col(ts)) - F.lit(horizon.reach * MICROS)
    return looked.filter(F.col("__error_us").isNull() | (F.col("__error_us") < window_start)).drop("__error_us")


def not_processed(examples: DataFrame, processed: DataFrame, keys: Sequence[str] = ("machine_id", "ts")) -> DataFrame:
    """examples that are not in the store yet."""
    return examples.join(processed.select(*pick(keys)).distinct(), list(keys), "left_anti")


def negatives_needed(positives: int, balance_ratio: float) -> int:
    """how many negatives give positives the share ``balance_ratio``."""
    return int(math.ceil(positives * ((1 / balance_ratio) - 1)))


def sample_examples(examples: DataFrame, n: int, seed: int, identity: Sequence[str] = ("machine_id", "ts"), ts: str = "ts") -> DataFrame:
    """F8: exactly ``n`` rows (or all, if fewer) drawn without replacement, repeatably."""
    ids: list[Column] = [epoch_us(col(c)) if c == ts else col(c) for c in identity]
    return keep_first(settle(examples, "candidates"), n, seed, ids)  # read twice: counts, then rows


def balanced_negatives(
    positives: DataFrame, candidates: DataFrame, balance_ratio: float, seed: int,
    stored: int = 0, identity: Sequence[str] = ("machine_id", "ts"), ts: str = "ts",
) -> DataFrame:
    """F8 + F9: as many fresh negatives as are still missing for the balance."""
    missing = max(negatives_needed(positives.count(), balance_ratio) - stored, 0)
    return sample_examples(candidates, missing, seed, identity, ts)

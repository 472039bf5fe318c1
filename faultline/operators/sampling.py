"""Balanced samples and folds (M1-M3)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.names import col, pick
from faultline.operators.ranks import draw_rank, value_rank
from faultline.params import NEGATIVE_LABEL


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(col(label)).count().collect()}


def negatives_for(positives: int, percentage: float) -> int:
    """Size of the negative class that gives positives the share ``percentage``."""
    return int(math.ceil(positives / percentage - positives))


def undersample(
    df: DataFrame, target: int, percentage: float, seed: int, identity: Sequence[str], label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """M1 and M2: (sample with all positives and exactly the wanted negatives, the other rows)."""
    ids = pick(identity)
    wanted = negatives_for(df.filter(col(label) == target).count(), percentage)
    marked = draw_rank(df, [label], seed, ids, "__rank")
    chosen = (col(label) == target) | ((col(label) == NEGATIVE_LABEL) & (F.col("__rank") <= wanted))
    return marked.filter(chosen).drop("__rank"), marked.filter(~chosen).drop("__rank")


def balance_classes(df: DataFrame, seed: int, identity: Sequence[str], label: str = "label") -> DataFrame:
    """Every class cut to the size of the smallest one."""
    smallest = min(class_counts(df, label).values(), default=0)
    if smallest == 0:
        return df.filter(F.lit(False))
    return draw_rank(df, [label], seed, pick(identity), "__rank", smallest).drop("__rank")


def _fold_of_rank(rank: Column, size: Column, start: Column, folds: int) -> Column:
    """Fold of the ``rank``-th (0-based) row of a class that occupies positions
    ``start .. start+size-1`` when rows are sorted by class.

    Position p would go to fold p mod k; a class therefore has a fixed number of rows per fold, and
    consecutive ranks fill one fold after the other. This keeps both the fold sizes and the class
    shares within one row of each other.
    """
    def up_to(i: Column) -> Column:  # rows of the class in folds 0..i
        end = start + size
        per_fold = lambda j: F.floor((end - 1 - j + folds) / folds) - F.floor((start - 1 - j + folds) / folds)
        return F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("bigint"), lambda acc, j: acc + per_fold(j))

    bounds = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: up_to(i))
    return F.size(F.filter(bounds, lambda b: b <= rank))


def assign_folds(
    df: DataFrame,
    folds: int,
    identity: Sequence[str],
    label: str = "label",
    shuffle_seed: int | None = 42,
    rows_of_slice: int = 1024,
    out: str = "fold",
) -> DataFrame:
    """M3: stratified fold number per row, in random order or (``shuffle_seed=None``) in order of
    the first identity column, which then must be an integer."""
    counts = {r["label"]: (r["n"], r["head"]) for r in df.groupBy(col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(identity[0])).alias("head")).collect()}
    short = [k for k, (n, _) in counts.items() if n < folds]
    if short:
        raise ValueError(f"{folds} folds need at least {folds} rows per class; too few for {short}")
    start, layout = 0, []
    for value, (n, _) in sorted(counts.items(), key=lambda kv: kv[1][1]):  # classes by first appearance
        layout.append((value, n, start))
        start += n
    size = F.coalesce(*[F.when(col(label) == v, F.lit(n)) for v, n, _ in layout])
    begin = F.coalesce(*[F.when(col(label) == v, F.lit(s)) for v, _, s in layout])
    if shuffle_seed is None:
        ranked = value_rank(df, [label], identity[0], rows_of_slice, "__rank")
    else:
        ranked = draw_rank(df, [label], shuffle_seed, pick(identity), "__rank")
    return ranked.withColumn(out, _fold_of_rank(F.col("__rank") - 1, size, begin, folds)).drop("__rank")

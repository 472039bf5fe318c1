"""Cross-validation and voting ensembles."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from faultline.operators import classifiers, metrics
from faultline.operators.oversampling import oversample
from faultline.operators.sampling import assign_folds, balance_classes, undersample
from faultline.session import settle

COLUMNS = ("id", "label", "x")


def _standardised(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides scaled with the training rows' mean and population deviation, per vector position."""
    per_position = (
        train.select(F.posexplode("x").alias("p", "v")).groupBy("p")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("p").collect()
    )
    mean = F.array(*[F.lit(float(r["m"])) for r in per_position])
    std = F.array(*[F.lit(float(r["s"])) for r in per_position])

    def scale(df: DataFrame) -> DataFrame:
        pairs = F.zip_with(mean, std, lambda m, s: F.struct(m.alias("m"), s.alias("s")))
        x = F.zip_with("x", pairs, lambda v, p: F.when(p["s"] > 0, (v - p["m"]) / p["s"]).otherwise(0.0))
        return df.withColumn("x", x)

    return scale(train), scale(test)


def cross_validate(
    rows: DataFrame,
    target: int,
    classifier: str,
    percentage: float,
    seed: int,
    folds: int = 5,
    oversampling: str | None = None,
    evaluate_all_data: bool = False,
    fit_scaler_per_fold: bool = False,
    classifier_options: Sequence[tuple[str, object]] = (),
) -> DataFrame:
    """M4 with M7 / M8: predictions (seed, fold, id, label, prediction, probability, fit_time, score_time).

    ``rows`` is (id, label, x). Under-sampling comes first; the test part is the fold, or the fold and
    everything that was not drawn. Over-sampling touches training rows only.
    """
    rows = settle(rows.select(*COLUMNS), "examples")
    drawn, rest = undersample(rows, target, percentage, seed, ["id"])
    drawn = settle(assign_folds(drawn, folds, ["id"]), "folds")
    parts = []
    for fold in range(folds):
        train = drawn.filter(F.col("fold") != fold).select(*COLUMNS)
        test = drawn.filter(F.col("fold") == fold).select(*COLUMNS)
        if evaluate_all_data and not oversampling:
            test = test.unionByName(rest.select(*COLUMNS))
        if fit_scaler_per_fold:
            train, test = _standardised(train, test)
        if oversampling:
            train = settle(oversample(train, oversampling, target, seed), "train")
        begun = time.monotonic()
        model = classifiers.fit(classifier, train, target, seed, **dict(classifier_options))
        fitted = time.monotonic()
        answers = settle(model.apply(test), "predictions")
        scored = time.monotonic()
        parts.append(answers.select(
            F.lit(seed).alias("seed"), F.lit(fold).alias("fold"), "*",
            F.lit(fitted - begun).alias("fit_time"), F.lit(scored - fitted).alias("score_time"),
        ))
    return reduce(DataFrame.unionByName, parts)


def evaluate(rows: DataFrame, target: int, classifier: str, percentage: float, seeds: Sequence[int], folds: int = 5,
             **options) -> DataFrame:
    """M4-M8: one summary row per seed (M6), with class sizes."""
    predictions = reduce(DataFrame.unionByName, [
        cross_validate(rows, target, classifier, percentage, seed, folds, **options) for seed in seeds])
    per_fold = metrics.scores(predictions, ["seed", "fold", "fit_time", "score_time"], target)
    return metrics.summary(per_fold, ["seed"])


def ensemble_predictions(
    rows: DataFrame, target: int, members: Sequence[str], seeds: Sequence[int], folds: int = 5,
) -> DataFrame:
    """M9 before the vote: long (fold, id, label, member, prediction, probability).

    Folds run over all data in order; every member is trained on its own balanced draw of the training
    part; the test part is balanced with seed 42.
    """
    if len(members) != len(seeds):
        raise ValueError("the number of classifiers and of seeds must be equal")
    placed = settle(assign_folds(rows.select(*COLUMNS), folds, ["id"], shuffle_seed=None), "folds")
    parts = []
    for fold in range(folds):
        train = placed.filter(F.col("fold") != fold).select(*COLUMNS)
        test = settle(balance_classes(placed.filter(F.col("fold") == fold).select(*COLUMNS), 42, ["id"]), "test")
        for number, (name, seed) in enumerate(zip(members, seeds)):
            model = classifiers.fit(name, settle(balance_classes(train, seed, ["id"]), "train"), target, seed)
            parts.append(model.apply(test).select(F.lit(fold).alias("fold"), F.lit(f"clf_{number}").alias("member"), "*"))
    return settle(reduce(DataFrame.unionByName, parts), "members")


def evaluate_ensemble(
    rows: DataFrame, target: int, members: Sequence[str], seeds: Sequence[int], folds: int = 5,
    voting: str = "hard", each_member: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """(summary of the vote, summary per member)."""
    answers = ensemble_predictions(rows, target, members, seeds, folds)
    voted = metrics.vote(answers, ["fold", "id", "label"], target, voting)
    total = metrics.summary(metrics.scores(voted, ["fold"], target))
    single = metrics.summary(metrics.scores(answers, ["member", "fold"], target), ["member"]) if each_member else None
    return total, single

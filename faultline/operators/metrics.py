"""Scores from predictions, as one aggregate (M5, M6, M9 vote, M10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.names import col, pick
from faultline.params import NEGATIVE_LABEL

SCORES = (
    "accuracy", "precision", "recall", "f1_score", "precision_neg", "recall_neg", "f1_score_neg",
)
COUNTS = ("tp", "tn", "fp", "fn")


def confusion(predictions: DataFrame, by: Sequence[str], target: int, label: str = "label", prediction: str = "prediction") -> DataFrame:
    truth, guess = col(label), col(prediction)

    def count(a: Column, b: Column) -> Column:
        return F.sum(F.when(a & b, 1).otherwise(0)).cast("bigint")

    yes, no = F.lit(target), F.lit(NEGATIVE_LABEL)
    return predictions.groupBy(*pick(by)).agg(
        count(truth == yes, guess == yes).alias("tp"), count(truth == no, guess == no).alias("tn"),
        count(truth == no, guess == yes).alias("fp"), count(truth == yes, guess == no).alias("fn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(predictions: DataFrame, by: Sequence[str], target: int, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M5 (and M10 with the classifier in ``by``): accuracy, and precision, recall, F1 of both classes;
    a ratio without a base is 0."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    return confusion(predictions, by, target, label, prediction).select(
        *pick(by), *COUNTS,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _ratio(tn, tn + fn).alias("precision_neg"), _ratio(tn, tn + fp).alias("recall_neg"),
        _ratio(2 * tn, 2 * tn + fp + fn).alias("f1_score_neg"),
    )


def summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M6: mean and population deviation over the folds, and summed counts."""
    extra = [c for c in ("fit_time", "score_time") if c in per_fold.columns]
    return per_fold.groupBy(*pick(by)).agg(
        *[e for s in (*SCORES, *extra) for e in (F.avg(col(s)).alias(f"{s}_mean"), F.stddev_pop(col(s)).alias(f"{s}_std"))],
        *[F.sum(col(c)).alias(c) for c in COUNTS],
    )


def vote(
    members: DataFrame, by: Sequence[str], target: int, voting: str = "hard",
    prediction: str = "prediction", probability: str = "probability",
) -> DataFrame:
    """M9: one prediction per row from all members. Ties go to the negative class, the smaller label."""
    if voting not in ("hard", "soft"):
        raise ValueError("voting must be 'hard' or 'soft'")
    if voting == "hard":
        wins = F.sum(F.when(col(prediction) == target, 1).otherwise(0)) * 2 > F.count(F.lit(1))
    else:
        wins = F.avg(col(probability)) > 0.5
    return members.groupBy(*pick(by)).agg(F.when(wins, F.lit(target)).otherwise(F.lit(NEGATIVE_LABEL)).alias("prediction"))


def beats_majority(scored: DataFrame) -> DataFrame:
    """Scores with ``majority``, the accuracy of always answering the larger class, and whether the model's is higher."""
    positives, negatives = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return scored.withColumn("majority", F.greatest(positives, negatives) / (positives + negatives)).withColumn("beats_majority", F.col("accuracy") > F.col("majority"))

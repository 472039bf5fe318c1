"""Classifiers are judged by what they find, not by their shape."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import classifiers, metrics
from faultline.params import NEGATIVE_LABEL
from faultline.plans import evaluation

TARGET = 7


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((240, 4))
    y = np.where(x[:, 0] + 0.7 * x[:, 1] > 0.3, TARGET, NEGATIVE_LABEL)
    return spark.createDataFrame([(i, int(c), v) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist(), strict=True))], "id long, label int, x array<double>").cache()


@pytest.mark.parametrize("name", list(classifiers.CLASSIFIERS))
def test_every_classifier_learns(rows, name):
    scored = metrics.beats_majority(metrics.scores(evaluation.cross_validate(rows, TARGET, name, 0.5, 3, 2), ["seed"], TARGET)).first()
    assert scored["beats_majority"] and scored["accuracy"] > 0.75, (name, scored["accuracy"])


@pytest.mark.parametrize("answer", [TARGET, NEGATIVE_LABEL])
def test_a_constant_answer_does_not(rows, answer):
    constant = rows.select(F.lit(0).alias("fold"), "label", F.lit(answer).alias("prediction"))
    assert not metrics.beats_majority(metrics.scores(constant, ["fold"], TARGET)).first()["beats_majority"]


def test_logistic_and_linear_machine_equal_plain_fits(rows):
    """Predictions agree with a Newton fit and with a least-squares separator in numpy nearly everywhere."""
    held = rows.orderBy("id").collect()
    x, y = np.array([r["x"] for r in held]), np.array([r["label"] == TARGET for r in held], float)
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(5)
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = design.T * (p * (1 - p)) @ design + 1e-3 * np.eye(5)
        w += np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
    for name in ("logistic", "svm_linear"):
        answers = classifiers.fit(name, rows, TARGET, 1).apply(rows).orderBy("id").collect()
        ours = np.array([r["prediction"] == TARGET for r in answers])
        assert (ours == (design @ w > 0)).mean() > 0.95, name

"""Sampling, folds, metrics, over-sampling and models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import classifiers, kernels, metrics, oversampling, sampling
from faultline.operators.neighbours import nearest
from faultline.operators.ranks import draw_rank, value_rank
from faultline.plans import evaluation

TARGET = 351


@pytest.fixture(scope="module")
def rows(spark):
    """Two overlapping clouds, 30 of the target against 120."""
    rng = np.random.default_rng(3)
    data = [(i, TARGET if i % 5 == 0 else -1, [float(v) for v in rng.normal(2.0 if i % 5 == 0 else 0.0, 1.0, 4)]) for i in range(150)]
    df = spark.createDataFrame(data, "id bigint, label int, x array<double>").cache()
    df.count()
    return df


def test_exact_undersampling(rows):
    drawn, rest = sampling.undersample(rows, TARGET, 0.4, 100, ["id"])
    assert sampling.class_counts(drawn) == {TARGET: 30, -1: 45}
    assert rest.count() == 75 and drawn.join(rest, "id").count() == 0
    other, _ = sampling.undersample(rows, TARGET, 0.4, 101, ["id"])
    assert drawn.select("id").exceptAll(other.select("id")).count() > 0


def test_ranks_are_complete(rows):
    got = sorted(r["rank"] for r in draw_rank(rows, ["label"], 1, [F.col("id")]).filter("label = -1").collect())
    assert got == list(range(1, 121))
    by_id = {r["id"]: r["rank"] for r in value_rank(rows, ["label"], "id", 16).filter(f"label = {TARGET}").collect()}
    assert [by_id[i] for i in range(0, 150, 5)] == list(range(1, 31))
    assert draw_rank(rows, ["label"], 1, [F.col("id")], at_most=7).count() == 14


@pytest.mark.parametrize("seed", [42, None])
@pytest.mark.parametrize("folds", [3, 5, 7])
def test_folds_are_balanced(rows, seed, folds):
    placed = sampling.assign_folds(rows, folds, ["id"], shuffle_seed=seed)
    sizes = placed.groupBy("label", "fold").count().collect()
    for label in (TARGET, -1):
        own = [r["count"] for r in sizes if r["label"] == label]
        assert len(own) == folds and max(own) - min(own) <= 1
    whole = [r["count"] for r in placed.groupBy("fold").count().collect()]
    assert max(whole) - min(whole) <= 1
    if seed is None:
        first = [r["id"] for r in placed.filter(f"label = {TARGET} and fold = 0").collect()]
        assert max(first) == 5 * (len(first) - 1)  # the lowest ids of the class


def test_too_few_rows_for_folds(spark):
    df = spark.createDataFrame([(1, TARGET), (2, -1), (3, -1)], "id bigint, label int")
    with pytest.raises(ValueError):
        sampling.assign_folds(df, 2, ["id"])


def test_scores_without_base_are_zero(spark):
    df = spark.createDataFrame([(0, -1, -1), (0, TARGET, -1), (1, TARGET, TARGET)], "fold int, label int, prediction int")
    got = {r["fold"]: r for r in metrics.scores(df, ["fold"], TARGET).collect()}
    assert (got[0]["precision"], got[0]["recall"], got[0]["f1_score"], got[0]["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    assert (got[1]["precision_neg"], got[1]["f1_score"], got[1]["tp"]) == (0.0, 1.0, 1)


def test_tied_votes_are_negative(spark):
    df = spark.createDataFrame([(1, TARGET, 0.5), (1, -1, 0.5), (2, TARGET, 0.9), (2, TARGET, 0.2), (3, -1, 0.9), (3, TARGET, 0.2)], "id int, prediction int, probability double")
    assert {r["id"]: r["prediction"] for r in metrics.vote(df, ["id"], TARGET).collect()} == {1: -1, 2: TARGET, 3: -1}
    assert {r["id"]: r["prediction"] for r in metrics.vote(df, ["id"], TARGET, "soft").collect()} == {1: -1, 2: TARGET, 3: TARGET}
    with pytest.raises(ValueError):
        metrics.vote(df, ["id"], TARGET, "loud")


def test_neighbours_equal_brute_force(rows, monkeypatch):
    monkeypatch.setattr("faultline.operators.neighbours.BLOCK_ROWS", 40)  # several blocks
    got = nearest(rows, rows, 3, carry=["label"]).collect()
    data = {r["id"]: np.array(r["x"]) for r in rows.collect()}
    ids = sorted(data)
    for query in ids[::17]:
        want = sorted((float(np.linalg.norm(data[query] - data[i])), i) for i in ids if i != query)[:3]
        own = sorted((r["place"], r["point_id"], r["distance"]) for r in got if r["query_id"] == query)
        assert [p for _, p, _ in own] == [i for _, i in want]
        np.testing.assert_allclose([d for *_, d in own], [d for d, _ in want])
    assert len(got) == 450


def _inside(point, a, b):
    """Is the point on the segment a-b?"""
    return abs(np.linalg.norm(point - a) + np.linalg.norm(b - point) - np.linalg.norm(b - a)) < 1e-9


@pytest.mark.parametrize("method", ["smote", "borderline_smote", "adasyn", "kmeans_smote", "svm_smote"])
def test_synthetic_rows_lie_between_parents(rows, method):
    done = oversampling.oversample(rows, method, TARGET, 7)
    made = [np.array(r["x"]) for r in done.filter("id is null").collect()]
    rare = [np.array(r["x"]) for r in rows.filter(f"label = {TARGET}").collect()]
    assert made and all(any(_inside(m, a, b) for a in rare for b in rare) for m in made)
    assert done.filter("id is not null").count() == 150
    if method in ("smote", "svm_smote", "borderline_smote", "kmeans_smote"):
        assert sampling.class_counts(done) == {TARGET: 120, -1: 120}


def test_random_oversampling_repeats_rows(rows):
    done = oversampling.oversample(rows, "random", TARGET, 7)
    assert sampling.class_counts(done) == {TARGET: 120, -1: 120}
    assert done.filter(f"label = {TARGET}").select("x").distinct().count() == 30


def test_categories_take_the_mode(rows):
    coded = rows.withColumn("x", F.transform("x", lambda v, i: F.when(i == 0, F.pmod(F.col("id"), F.lit(2)).cast("double")).otherwise(v)))
    made = oversampling.oversample(coded, "smotenc", TARGET, 7, categorical=[0]).filter("id is null").collect()
    assert len(made) == 90 and {r["x"][0] for r in made} <= {0.0, 1.0}


@pytest.mark.parametrize("method", ["smote_tomek", "smote_enn"])
def test_cleaning_removes_rows(rows, method):
    done = oversampling.oversample(rows, method, TARGET, 7)
    kept = done.count()
    assert 150 < kept <= 240 and done.filter("id is not null").join(rows, "id").count() > 100


def test_mutual_neighbours_of_opposite_class_go(spark):
    data = [(1, TARGET, [0.0]), (2, -1, [0.1]), (3, -1, [5.0]), (4, -1, [5.1]), (5, TARGET, [5.3]), (6, TARGET, [9.0]), (7, TARGET, [9.1])]
    df = spark.createDataFrame(data, "id bigint, label int, x array<double>")
    assert sorted(r["id"] for r in oversampling.drop_tomek_links(df).collect()) == [3, 4, 5, 6, 7]
    assert sorted(r["id"] for r in oversampling.edit_neighbours(df, 1).collect()) == [3, 4, 6, 7]


def test_unknown_method(rows):
    with pytest.raises(ValueError):
        oversampling.oversample(rows, "none", TARGET)


def test_fourier_map_approximates_the_kernel():
    x = np.random.default_rng(0).normal(size=(20, 3))
    z = kernels.FourierMap.draw(3, 0.3, 20_000, 1).apply(x)
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(z @ z.T, want, atol=0.05)


def test_landmark_map_reproduces_the_kernel_on_landmarks(rows):
    kernel = kernels.polynomial(0.5, 2, 1.0)
    fitted = kernels.LandmarkMap.fit(rows, kernel, m=40)
    z = fitted.apply(fitted.landmarks)
    np.testing.assert_allclose(z @ z.T, kernel(fitted.landmarks, fitted.landmarks), rtol=1e-6, atol=1e-6)
    assert len(kernels.LandmarkMap.fit(rows, kernel, m=10_000).landmarks) == rows.count()  # no bound but the parameter


@pytest.mark.parametrize("name", ["random_forest", "svm_linear", "svm_rbf", "svm_poly", "svm_sigmoid", "logistic", "svm_linear_probability"])
def test_classifiers_learn_separable_classes(rows, name):
    answers = classifiers.fit(name, rows, TARGET, 1).apply(rows)
    got = metrics.scores(answers.withColumn("all", F.lit(1)), ["all"], TARGET).first()
    assert got["accuracy"] > 0.8 and answers.count() == 150
    if name in ("random_forest", "logistic", "svm_linear_probability"):
        low, high = answers.agg(F.min("probability"), F.max("probability")).first()
        assert 0 <= low < high <= 1


def test_unknown_classifier(rows):
    with pytest.raises(ValueError):
        classifiers.fit("none", rows, TARGET)


def test_cross_validation_covers_the_sample_once(rows):
    answers = evaluation.cross_validate(rows, TARGET, "logistic", 0.5, 100, 3)
    assert answers.count() == 60 and answers.select("id").distinct().count() == 60
    every = evaluation.cross_validate(rows, TARGET, "logistic", 0.5, 100, 3, evaluate_all_data=True, fit_scaler_per_fold=True)
    assert every.count() == 60 + 3 * 90


def test_evaluation_summary(rows):
    got = evaluation.evaluate(rows, TARGET, "logistic", 0.5, [100, 101], 3).collect()
    assert [r["tp"] + r["tn"] + r["fp"] + r["fn"] for r in got] == [60, 60]
    assert all(0 <= r["accuracy_mean"] <= 1 and r["fit_time_mean"] > 0 for r in got)


def test_ensemble(rows):
    total, single = evaluation.evaluate_ensemble(rows, TARGET, ["logistic", "logistic"], [1, 2], 3, "soft")
    assert total.first()["tp"] + total.first()["fn"] == 30 and single.count() == 2
    with pytest.raises(ValueError):
        evaluation.ensemble_predictions(rows, TARGET, ["logistic"], [1, 2])

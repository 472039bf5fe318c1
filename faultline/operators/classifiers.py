"""Estimator choices on Spark ML (K1-K8).

Rows are (id, label, x): ``label`` is the target code or -1, ``x`` an array of doubles. A fitted
model adds ``prediction`` (label) and, where it has one, ``probability`` of the target.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.kernels import FourierMap, LandmarkMap, default_gamma, polynomial, sigmoid
from faultline.operators.sampling import balance_classes
from faultline.params import NEGATIVE_LABEL


def _binary(df: DataFrame, target: int) -> DataFrame:
    return df.withColumns({"__v": array_to_vector("x"), "__y": (F.col("label") == target).cast("double")})


def _answer(df: DataFrame, target: int, positive: Column, probability: Column | None = None) -> DataFrame:
    chance = probability if probability is not None else F.lit(None).cast("double")
    return df.withColumns({
        "__p": F.when(positive, F.lit(target)).otherwise(F.lit(NEGATIVE_LABEL)), "__q": chance,
    }).select("id", "label", F.col("__p").alias("prediction"), F.col("__q").alias("probability"))


@dataclass(frozen=True)
class Fitted:
    """A trained classifier: ``apply`` maps rows (id, label, x) to (id, label, prediction, probability)."""

    apply: Callable[[DataFrame], DataFrame]


def random_forest(train: DataFrame, target: int, seed: int = 0, trees: int = 100, depth: int = 10) -> Fitted:
    """K1, with balanced class weights n / (2 n_class)."""
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.when(F.col("label") == target, F.lit(total / (2 * max(counts.get(target, 0), 1)))).otherwise(
        F.lit(total / (2 * max(total - counts.get(target, 0), 1))))
    model = RandomForestClassifier(
        featuresCol="__v", labelCol="__y", weightCol="__w", numTrees=trees, maxDepth=depth, seed=seed,
    ).fit(_binary(train, target).withColumn("__w", weight))
    return Fitted(lambda df: _with_probability(model.transform(_binary(df, target)), target))


def _with_probability(scored: DataFrame, target: int) -> DataFrame:
    chance = vector_to_array(F.col("probability"))[1]
    hit = F.col("prediction") == 1.0
    return _answer(scored.withColumns({"__hit": hit, "__chance": chance}), target, F.col("__hit"), F.col("__chance"))


def logistic(train: DataFrame, target: int, seed: int = 0) -> Fitted:
    """K6, with the usual unit L2 penalty on the summed loss (1/n on Spark's mean loss)."""
    n = max(train.count(), 1)
    model = LogisticRegression(
        featuresCol="__v", labelCol="__y", maxIter=100, regParam=1.0 / n, tol=1e-4, standardization=False,
    ).fit(_binary(train, target))
    return Fitted(lambda df: _with_probability(model.transform(_binary(df, target)), target))


def _fit_svm(train: DataFrame, target: int):
    n = max(train.count(), 1)
    return LinearSVC(
        featuresCol="__v", labelCol="__y", maxIter=100, regParam=1.0 / n, tol=1e-3, standardization=False,
    ).fit(_binary(train, target))


def svm_linear(train: DataFrame, target: int, seed: int = 0) -> Fitted:
    """K2."""
    model = _fit_svm(train, target)
    return Fitted(lambda df: _answer(model.transform(_binary(df, target)).withColumn("__hit", F.col("prediction") == 1.0),
                                     target, F.col("__hit")))


def svm_linear_probability(train: DataFrame, target: int, seed: int = 0) -> Fitted:
    """K8: linear SVM whose margin is turned into a probability by a logistic fit (Platt)."""
    model = _fit_svm(train, target)

    def margins(df: DataFrame) -> DataFrame:
        scored = model.transform(_binary(df, target))
        margin = vector_to_array(F.col("rawPrediction"))[1]
        return scored.select("id", "label", "__y", F.col("prediction").alias("__hard"), array_to_vector(F.array(margin)).alias("__m"))

    curve = LogisticRegression(featuresCol="__m", labelCol="__y", maxIter=50).fit(margins(train))

    def apply(df: DataFrame) -> DataFrame:
        scored = curve.transform(margins(df))
        chance = vector_to_array(F.col("probability"))[1]
        return _answer(scored.withColumn("__chance", chance), target, F.col("__hard") == 1.0, F.col("__chance"))

    return Fitted(apply)


def _width(df: DataFrame) -> int:
    return df.select(F.size("x")).first()[0]


def svm_rbf(train: DataFrame, target: int, seed: int = 0, size: int = 256) -> Fitted:
    """K3: random Fourier features + linear SVM."""
    width = _width(train)
    to_space = FourierMap.draw(width, default_gamma(train, width), size, seed)
    inner = svm_linear(to_space.transform(train), target, seed)
    return Fitted(lambda df: inner.apply(to_space.transform(df)))


def _svm_landmarks(train: DataFrame, target: int, kernel: Callable, seed: int, landmarks: int) -> Fitted:
    to_space = LandmarkMap.fit(train.filter(F.col("id").isNotNull()), kernel, landmarks, seed)
    inner = svm_linear(to_space.transform(train), target, seed)
    return Fitted(lambda df: inner.apply(to_space.transform(df)))


def svm_poly(train: DataFrame, target: int, seed: int = 0, landmarks: int = 128) -> Fitted:
    """K4: landmark map of the cubic kernel + linear SVM; ``landmarks`` training rows carry the map."""
    return _svm_landmarks(train, target, polynomial(default_gamma(train, _width(train))), seed, landmarks)


def svm_sigmoid(train: DataFrame, target: int, seed: int = 0, landmarks: int = 128) -> Fitted:
    """K5: landmark map of the tanh kernel + linear SVM; ``landmarks`` training rows carry the map."""
    return _svm_landmarks(train, target, sigmoid(default_gamma(train, _width(train))), seed, landmarks)


def easy_ensemble(train: DataFrame, target: int, seed: int = 0, bags: int = 10, rounds: int = 10) -> Fitted:
    """K7, approximation: gradient-boosted stumps instead of AdaBoost on differently drawn balanced
    bags; the mean probability decides."""
    models = [
        GBTClassifier(featuresCol="__v", labelCol="__y", maxIter=rounds, maxDepth=1, seed=seed + b)
        .fit(_binary(balance_classes(train, seed + b, ["id"]), target))
        for b in range(bags)
    ]

    def apply(df: DataFrame) -> DataFrame:
        scored = _binary(df, target)
        for b, model in enumerate(models):
            done = model.transform(scored)
            scored = done.withColumn(f"__b{b}", vector_to_array(F.col("probability"))[1]).drop(
                "rawPrediction", "probability", "prediction")
        mean = sum((F.col(f"__b{b}") for b in range(bags)), F.lit(0.0)) / bags
        return _answer(scored.withColumn("__mean", mean), target, F.col("__mean") > 0.5, F.col("__mean"))

    return Fitted(apply)


CLASSIFIERS: dict[str, Callable[..., Fitted]] = {
    "random_forest": random_forest, "svm_linear": svm_linear, "svm_rbf": svm_rbf, "svm_poly": svm_poly,
    "svm_sigmoid": svm_sigmoid, "logistic": logistic, "easy_ensemble": easy_ensemble,
    "svm_linear_probability": svm_linear_probability,
}


def fit(name: str, train: DataFrame, target: int, seed: int = 0, **options) -> Fitted:
    """The named classifier; ``options`` are its own, as ``size`` of K3 or ``landmarks`` of K4 and K5."""
    if name not in CLASSIFIERS:
        raise ValueError(f"classifier must be one of {sorted(CLASSIFIERS)}")
    return CLASSIFIERS[name](train, target, seed, **options)

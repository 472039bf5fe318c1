"""Over-sampling of the rare class in a training fold (M7a-i).

Rows are (id, label, x) with ``x`` an array of doubles. Synthetic rows get a null id. All draws are
hashes of row id and copy number, so a retried task draws the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.keys import uniform
from faultline.operators.neighbours import nearest
from faultline.operators.ranks import draw_rank
from faultline.params import NEGATIVE_LABEL
from faultline.session import settle

METHODS = (
    "random", "smote", "smotenc", "borderline_smote", "adasyn", "kmeans_smote", "svm_smote", "smote_tomek", "smote_enn",
)


def _sides(train: DataFrame, target: int) -> tuple[DataFrame, int, int]:
    row = train.agg(F.count(F.when(F.col("label") == target, 1)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    return train.filter(F.col("label") == target), row["p"], row["n"] - row["p"]


def random_oversample(train: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Minority rows repeated until the classes are equal; each row floor or ceil of the mean number of times."""
    rare, p, n = _sides(train, target)
    if p == 0 or p >= n:
        return train
    whole, rest = divmod(n, p)
    ranked = draw_rank(rare, ["label"], seed, [F.col("id")], "__rank")
    times = F.lit(whole) + F.when(F.col("__rank") <= rest, 1).otherwise(0)
    copies = ranked.withColumn("__copy", F.explode(F.sequence(F.lit(1), times)))
    fresh = copies.withColumn("id", F.when(F.col("__copy") == 1, F.col("id"))).select(*train.columns)
    return train.filter(F.col("label") != target).unionByName(fresh)


def _quota(seeds: DataFrame, total: int, seed: int) -> DataFrame:
    """Seeds with the number of synthetic rows each has to give, ``total`` in all."""
    count = seeds.count()
    if count == 0:
        return seeds.withColumn("quota", F.lit(0)).filter(F.lit(False))
    whole, rest = divmod(total, count)
    ranked = draw_rank(seeds.withColumn("__all", F.lit(0)), ["__all"], seed, [F.col("id")], "__rank")
    return ranked.withColumn("quota", F.lit(whole) + F.when(F.col("__rank") <= rest, 1).otherwise(0)).drop("__rank", "__all")


def _between(a: Column, b: Column, u: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + u * (q - p))


def synthesise(
    seeds: DataFrame, pool: DataFrame, target: int, k: int = 5, seed: int = 0, categorical: Sequence[int] = (),
) -> DataFrame:
    """Synthetic rows on the segment from a seed (with ``quota``) to one of its k nearest in ``pool``.

    Positions in ``categorical`` take the most frequent value among the neighbours (ties: smallest) instead.
    """
    near = nearest(seeds, pool, k, carry=["x"], seed=seed).withColumnRenamed("x", "y")
    members = near.groupBy(F.col("query_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("place", "y"))).alias("near"))
    drawn = (
        seeds.filter("quota > 0").join(members, "id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("quota"))))
        .withColumn("pick", F.floor(uniform(seed, F.col("id"), F.col("copy")) * F.size("near")).cast("int") + 1)
        .withColumn("u", uniform(seed + 1, F.col("id"), F.col("copy")))
    )
    x = _between(F.col("x"), F.element_at("near", F.col("pick"))["y"], F.col("u"))
    if categorical:
        # Mode per position: sort by (-count, value) over at most k neighbours.
        def mode(position: Column) -> Column:
            seen = F.transform(F.col("near"), lambda m: F.element_at(m["y"], position + 1))
            ranked = F.transform(F.array_distinct(seen), lambda v: F.struct(
                -F.size(F.filter(seen, lambda w: w == v)).alias("n"), v.alias("v")))
            return F.array_min(ranked)["v"]

        fixed = F.array(*[F.lit(c) for c in categorical])
        x = F.transform(x, lambda value, i: F.when(F.array_contains(fixed, i), mode(i)).otherwise(value))
    return drawn.select(F.lit(None).cast("bigint").alias("id"), F.lit(target).alias("label"), x.alias("x"))


def smote(train: DataFrame, target: int, k: int = 5, seed: int = 0, categorical: Sequence[int] = ()) -> DataFrame:
    """M7b (M7c with ``categorical``): seeds are all minority rows."""
    rare, p, n = _sides(train, target)
    if p < 2 or p >= n:
        return train
    return train.unionByName(synthesise(_quota(rare, n - p, seed), rare, target, min(k, p - 1), seed, categorical))


def _majority_share(rare: DataFrame, train: DataFrame, m: int, seed: int) -> DataFrame:
    """Minority rows with the share of majority rows among their ``m`` neighbours."""
    near = nearest(rare, train, m, carry=["label"], seed=seed)
    share = near.groupBy(F.col("query_id").alias("id")).agg(F.avg(F.when(F.col("label") == NEGATIVE_LABEL, 1.0).otherwise(0.0)).alias("share"))
    return rare.join(share, "id")


def borderline_smote(train: DataFrame, target: int, k: int = 5, m: int = 10, seed: int = 0) -> DataFrame:
    """M7d: seeds are minority rows with at least half, but not all, majority neighbours."""
    rare, p, n = _sides(train, target)
    if p < 2 or p >= n:
        return train
    seeds = _majority_share(rare, train, m, seed).filter((F.col("share") >= 0.5) & (F.col("share") < 1.0)).drop("share")
    return train.unionByName(synthesise(_quota(seeds, n - p, seed), rare, target, min(k, p - 1), seed))


def adasyn(train: DataFrame, target: int, k: int = 5, seed: int = 0) -> DataFrame:
    """M7e: a minority row gives synthetic rows in proportion to the majority share around it (rounded)."""
    rare, p, n = _sides(train, target)
    if p < 2 or p >= n:
        return train
    shares = _majority_share(rare, train, k, seed)
    total = shares.agg(F.sum("share")).first()[0] or 0.0
    if total == 0:
        return train
    quota = F.round(F.col("share") / F.lit(total) * F.lit(n - p)).cast("int")
    seeds = shares.withColumn("quota", quota).drop("share")
    return train.unionByName(synthesise(seeds, rare, target, min(k, p - 1), seed))


def kmeans_smote(train: DataFrame, target: int, clusters: int = 8, k: int = 2, seed: int = 0, share: float = 0.5) -> DataFrame:
    """M7f: SMOTE inside clusters where the minority holds at least ``share`` (by cluster count, equal quota per seed)."""
    rare, p, n = _sides(train, target)
    if p < 2 or p >= n:
        return train
    spread = train.withColumn("__v", array_to_vector("x"))
    model = KMeans(k=min(clusters, p + n), seed=seed, featuresCol="__v", predictionCol="cluster").fit(spread)
    where = model.transform(spread).drop("__v")
    heavy = where.groupBy("cluster").agg(
        F.count(F.when(F.col("label") == target, 1)).alias("rare"), F.count(F.lit(1)).alias("size"))
    chosen = [r["cluster"] for r in heavy.filter((F.col("rare") > 1) & (F.col("rare") >= share * F.col("size"))).collect()]
    if not chosen:
        return train
    seeds = _quota(where.filter((F.col("label") == target) & F.col("cluster").isin(chosen)), n - p, seed)
    out = train
    for cluster in chosen:
        own = seeds.filter(F.col("cluster") == cluster).drop("cluster")
        out = out.unionByName(synthesise(own, own.drop("quota"), target, k, seed))
    return out


def svm_smote(train: DataFrame, target: int, k: int = 5, seed: int = 0, closest: float = 0.5) -> DataFrame:
    """M7g, approximation: seeds are the minority rows nearest to a linear SVM's border, instead of
    its support vectors, which the distributed solver does not expose."""
    rare, p, n = _sides(train, target)
    if p < 2 or p >= n:
        return train
    spread = train.withColumns({"__v": array_to_vector("x"), "__y": (F.col("label") == target).cast("double")})
    model = LinearSVC(featuresCol="__v", labelCol="__y", maxIter=50, regParam=0.01).fit(spread)
    weights, bias = [float(w) for w in model.coefficients], float(model.intercept)
    product = F.zip_with(F.col("x"), F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
    margin = F.abs(F.aggregate(product, F.lit(bias), lambda acc, v: acc + v))
    scored = rare.withColumn("margin", margin)
    limit = scored.agg(F.percentile("margin", F.lit(closest))).first()[0]
    seeds = scored.filter(F.col("margin") <= F.lit(limit)).drop("margin")
    return train.unionByName(synthesise(_quota(seeds, n - p, seed), rare, target, min(k, p - 1), seed))


def _numbered(train: DataFrame) -> DataFrame:
    """Ids for synthetic rows too, marked as made: hashes of content and, among equal rows, of a running number."""
    copies = Window.partitionBy("label", "x").orderBy(F.lit(0))
    made = train.filter("id IS NULL").withColumn("__copy", F.row_number().over(copies))
    made = made.withColumn("id", F.xxhash64("label", "x", "__copy")).drop("__copy").withColumn("__made", F.lit(True))
    return train.filter("id IS NOT NULL").withColumn("__made", F.lit(False)).unionByName(made)


def _unnumber(train: DataFrame) -> DataFrame:
    return train.withColumn("id", F.when(~F.col("__made"), F.col("id"))).drop("__made")


def drop_tomek_links(train: DataFrame, seed: int = 0) -> DataFrame:
    """Delete pairs of opposite class that are each other's nearest neighbour."""
    first = nearest(train, train, 1, carry=["label"], seed=seed).select("query_id", "point_id", F.col("label").alias("other"))
    one = first.join(train.select(F.col("id").alias("query_id"), "label"), "query_id").filter(F.col("label") != F.col("other"))
    back = one.select(F.col("query_id").alias("point_id"), F.col("point_id").alias("query_id"))
    links = one.join(back, ["query_id", "point_id"], "left_semi")
    return train.join(links.select(F.col("query_id").alias("id")), "id", "left_anti")


def edit_neighbours(train: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Delete rows whose k nearest neighbours are not all of their own class."""
    near = nearest(train, train, k, carry=["label"], seed=seed).select(F.col("query_id").alias("id"), F.col("label").alias("other"))
    votes = near.join(train.select("id", "label"), "id")
    wrong = votes.filter(F.col("label") != F.col("other")).select("id").distinct()
    return train.join(wrong, "id", "left_anti")


def smote_tomek(train: DataFrame, target: int, k: int = 5, seed: int = 0) -> DataFrame:
    """M7h."""
    return _unnumber(drop_tomek_links(settle(_numbered(smote(train, target, k, seed)), "numbered"), seed))


def smote_enn(train: DataFrame, target: int, k: int = 5, seed: int = 0) -> DataFrame:
    """M7i."""
    return _unnumber(edit_neighbours(settle(_numbered(smote(train, target, k, seed)), "numbered"), 3, seed))


def oversample(train: DataFrame, method: str, target: int, seed: int = 0, categorical: Sequence[int] = ()) -> DataFrame:
    """M7: apply a method by name."""
    if method not in METHODS:
        raise ValueError(f"over-sampling method must be one of {METHODS}")
    if method == "smotenc":
        return smote(train, target, seed=seed, categorical=categorical)
    apply = {
        "random": random_oversample, "smote": smote, "borderline_smote": borderline_smote, "adasyn": adasyn,
        "kmeans_smote": kmeans_smote, "svm_smote": svm_smote, "smote_tomek": smote_tomek, "smote_enn": smote_enn,
    }[method]
    return apply(train, target, seed=seed)

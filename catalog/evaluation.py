"""M1-M11 and K1-K8 on the embeddings: one label against the rest."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import log, query, r6, sql_r6, table
from catalog.labels import draw_sql
from faultline.operators import metrics, oversampling, sampling
from faultline.operators.classifiers import CLASSIFIERS
from faultline.params import NEGATIVE_LABEL, Horizon, MiningParams, parameter_grid
from faultline.plans import evaluation, grid
from faultline.session import settle, shared_dir
from faultline.sources import stores

TARGET = 7  # class label of the positive rows
SEED, FOLDS, SHARE = 100, 5, 0.4

_ROWS = f"rows AS (SELECT vec_id AS id, CASE WHEN label = 7 THEN {TARGET} ELSE {NEGATIVE_LABEL} END AS label FROM embeddings)"
_RANKED = f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(SEED, 'id')}, id) AS rn FROM rows)"
_NEED = f"(SELECT ceil(count(*) / {SHARE} - count(*)) FROM rows WHERE label = {TARGET})"


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x)."""
    label = F.when(F.col("label") == 7, F.lit(TARGET)).otherwise(F.lit(NEGATIVE_LABEL))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {_ROWS}, {_RANKED} SELECT id, label FROM r WHERE label = {TARGET} OR rn <= {_NEED}")
def undersampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(examples(spark, sf_dir), TARGET, SHARE, SEED, ["id"])[0].select("id", "label")


@query(f"WITH {_ROWS}, {_RANKED} SELECT id, label FROM r WHERE NOT (label = {TARGET} OR rn <= {_NEED})")
def not_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(examples(spark, sf_dir), TARGET, SHARE, SEED, ["id"])[1].select("id", "label")


def _fold_sql(order: str, folds: int = FOLDS) -> str:
    """Sorted by class (first appearance first), position p would go to fold p mod k: gives each fold's size per class;
    the class's rows then fill the folds one after the other."""
    return f"""WITH {_ROWS}, c AS (SELECT label, count(*) AS n, min(id) AS head FROM rows GROUP BY 1),
s AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
p AS (SELECT label, (start + i) % {folds} AS fold, count(*) AS size FROM s, LATERAL (SELECT unnest(range(n)) AS i) GROUP BY 1, 2),
b AS (SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) AS upto, sum(size) OVER (PARTITION BY label ORDER BY fold) - size AS since FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) - 1 AS rn FROM rows)
SELECT r.id, r.label, CAST(b.fold AS INT) AS fold FROM r JOIN b ON b.label = r.label AND r.rn >= b.since AND r.rn < b.upto"""


@query(_fold_sql(draw_sql(42, "id") + ", id"))
def folds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_folds(examples(spark, sf_dir), FOLDS, ["id"]).select("id", "label", "fold")


@query(_fold_sql("id"))
def folds_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_folds(examples(spark, sf_dir), FOLDS, ["id"], shuffle_seed=None).select("id", "label", "fold")


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members with fixed rules in place of models, and a fold."""
    rows = examples(spark, sf_dir).select("id", "label", (F.col("id") % FOLDS).cast("int").alias("fold"))
    members = [(f"clf_{m}", (F.col("id") * (m + 3) % 7 < 2) | ((F.col("label") == TARGET) & (F.col("id") % (m + 2) == 0))) for m in range(3)]
    return reduce(DataFrame.unionByName, [
        rows.select(F.lit(name).alias("member"), "*", F.when(hit, TARGET).otherwise(NEGATIVE_LABEL).alias("prediction"),
                    F.when(hit, F.lit(0.9)).otherwise(F.col("id") % 10 / 20).alias("probability"))
        for name, hit in members])


_GUESS = f"""{_ROWS}, g AS ({" UNION ALL ".join(
    f"SELECT 'clf_{m}' AS member, id, label, CAST(id % {FOLDS} AS INT) AS fold, (id * {m + 3} % 7 < 2) OR (label = {TARGET} AND id % {m + 2} = 0) AS hit FROM rows" for m in range(3))}),
guess AS (SELECT member, id, label, fold, CASE WHEN hit THEN {TARGET} ELSE {NEGATIVE_LABEL} END AS prediction, CASE WHEN hit THEN 0.9::DOUBLE ELSE (id % 10) / 20 END AS probability FROM g)"""


def _scores_sql(source: str, by: str, rounded: bool = True) -> str:
    count = lambda a, b: f"count(*) FILTER (label = {a} AND prediction = {b})"
    y, n = TARGET, NEGATIVE_LABEL
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END"
    shown = {
        "accuracy": ratio("tp + tn", "tp + tn + fp + fn"), "precision": ratio("tp", "(tp + fp)"), "recall": ratio("tp", "(tp + fn)"),
        "f1_score": ratio("2 * tp", "(2 * tp + fp + fn)"), "precision_neg": ratio("tn", "(tn + fn)"), "recall_neg": ratio("tn", "(tn + fp)"),
        "f1_score_neg": ratio("2 * tn", "(2 * tn + fp + fn)")}
    values = ", ".join(f"{sql_r6(e) if rounded else e} AS {k}" for k, e in shown.items())
    return (f"SELECT {by}, tp, tn, fp, fn, {values} FROM (SELECT {by}, {count(y, y)} AS tp, {count(n, n)} AS tn, {count(n, y)} AS fp, {count(y, n)} AS fn "
            f"FROM {source} GROUP BY {by})")


def _rounded_scores(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in metrics.SCORES else F.col(c) for c in df.columns])


@query(f"WITH {_GUESS} {_scores_sql('guess', 'member, fold')}")
def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_scores(metrics.scores(guesses(spark, sf_dir), ["member", "fold"], TARGET))


@query(f"WITH {_GUESS}, s AS ({_scores_sql('guess', 'member, fold', False)}) SELECT member, " + ", ".join(
    f"{sql_r6(f'avg({s})')} AS {s}_mean, {sql_r6(f'stddev_pop({s})')} AS {s}_std" for s in metrics.SCORES)
    + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in metrics.COUNTS) + " FROM s GROUP BY member")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = metrics.summary(metrics.scores(guesses(spark, sf_dir), ["member", "fold"], TARGET), ["member"])
    return done.select(*[r6(F.col(c)).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in done.columns])


def _vote_sql(wins: str) -> str:
    return f"""WITH {_GUESS}, v AS (SELECT fold, id, label, CASE WHEN {wins} THEN {TARGET} ELSE {NEGATIVE_LABEL} END AS prediction FROM guess WHERE member <> 'clf_2' OR fold > 1 GROUP BY 1, 2, 3)
{_scores_sql('v', 'fold')}"""


def _voted(spark: SparkSession, sf_dir: str, voting: str) -> DataFrame:
    members = guesses(spark, sf_dir).filter("member <> 'clf_2' OR fold > 1")  # two members in some folds: ties
    return _rounded_scores(metrics.scores(metrics.vote(members, ["fold", "id", "label"], TARGET, voting), ["fold"], TARGET))


@query(_vote_sql(f"count(*) FILTER (prediction = {TARGET}) * 2 > count(*)"))
def hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, "hard")


@query(_vote_sql("avg(probability) > 0.5"))
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, "soft")


def _drawn_sql(share: float, folds: int) -> str:
    """Rows of a draw with the given share of positives, and their fold."""
    limit = f"(SELECT ceil(count(*) / {share} - count(*)) FROM every WHERE label = {TARGET})"
    return _fold_sql(draw_sql(42, "id") + ", id", folds).replace(
        _ROWS, f"every AS ({_ROWS.removeprefix('rows AS (').removesuffix(')')}), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(SEED, 'id')}, id) AS place FROM every), "
        f"rows AS (SELECT id, label FROM ranked WHERE label = {TARGET} OR place <= {limit})")


def _fold_sizes_sql(share: float, folds: int, all_data: bool = False) -> str:
    """What is sure about scores of models: sizes of the test parts, and scores between 0 and 1."""
    rest = " + (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM placed)" if all_data else ""
    return (f"WITH placed AS ({_drawn_sql(share, folds)}) SELECT {SEED} AS seed, fold, count(*) FILTER (label = {TARGET}) AS positives, "
            f"count(*) FILTER (label <> {TARGET}){rest} AS negatives, TRUE AS scores_bounded FROM placed GROUP BY fold")


def _sizes(answers: DataFrame) -> DataFrame:
    """Sizes of the test parts from the counts of the metrics, and whether all scores lie between 0 and 1."""
    scored = metrics.scores(answers, ["seed", "fold"], TARGET)
    bounded = reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in metrics.SCORES])
    return scored.select("seed", "fold", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"), bounded.alias("scores_bounded"))


def _register_classifier(name: str) -> None:
    def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sizes(evaluation.cross_validate(examples(spark, sf_dir), TARGET, name, 0.5, SEED, 3))
    validated.__name__ = f"cross_validated_{name}"
    query(_fold_sizes_sql(0.5, 3))(validated)


for _name in CLASSIFIERS:
    _register_classifier(_name)


@query(_fold_sizes_sql(0.5, 3, all_data=True))
def cross_validated_all_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were not sampled are scored along with each test fold; scaling is fitted per fold."""
    answers = evaluation.cross_validate(examples(spark, sf_dir), TARGET, "svm_linear", 0.5, SEED, 3,
                                        evaluate_all_data=True, fit_scaler_per_fold=True)
    return _sizes(answers)


@query(_fold_sizes_sql(0.3, 3))
def cross_validated_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE on the training part only."""
    answers = evaluation.cross_validate(examples(spark, sf_dir), TARGET, "logistic", 0.3, SEED, 3, oversampling="smote")
    return _sizes(answers)


@query()
def ensemble_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced members on in-order folds, soft vote; scores of each member and of the vote."""
    answers = evaluation.ensemble_predictions(examples(spark, sf_dir), TARGET, ["svm_linear_probability", "logistic"], [1, 2], 3)
    voted = metrics.vote(answers, ["fold", "id", "label"], TARGET, "soft").withColumn("member", F.lit("vote"))
    every = answers.select("member", "fold", "label", "prediction").unionByName(voted.select("member", "fold", "label", "prediction"))
    return metrics.scores(every, ["member", "fold"], TARGET)


# Methods that fill the rare class up to the size of the other one, and keep every original row.
_FILLED = ("random", "smote", "smotenc", "svm_smote")
_FILLED_SQL = f"""WITH {_ROWS} SELECT label, CAST(max(count(*)) OVER () AS BIGINT) AS n, count(*) AS original FROM rows GROUP BY label"""


def _register_oversampling(method: str) -> None:
    def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = settle(examples(spark, sf_dir), "train")
        done = settle(oversampling.oversample(rows, method, TARGET, SEED, categorical=[0, 1]), "oversampled")
        return done.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("original"))
    oversampled.__name__ = f"oversampled_{method}"
    query(_FILLED_SQL if method in _FILLED else None)(oversampled)


for _name in oversampling.METHODS:
    _register_oversampling(_name)


@query(_fold_sql(draw_sql(42, "id") + ", id").replace(
    _ROWS, f"every AS ({_ROWS.removeprefix('rows AS (').removesuffix(')')}), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(SEED, 'id')}, id) AS place FROM every), "
    f"rows AS (SELECT id, label FROM ranked WHERE label = {TARGET} OR place <= (SELECT count(*) FROM every WHERE label = {TARGET}))").replace(
    "SELECT r.id, r.label, CAST(b.fold AS INT) AS fold FROM", f"SELECT {SEED} AS seed, CAST(b.fold AS INT) AS fold, r.id, r.label FROM"))
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a cross-validation predicts in which fold."""
    answers = evaluation.cross_validate(examples(spark, sf_dir), TARGET, "logistic", 0.5, SEED, FOLDS)
    return answers.select("seed", "fold", "id", "label")


@query()
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every classifier over all folds of a balanced draw, and whether it beats the answer that is always the larger class."""
    rows = settle(examples(spark, sf_dir), "examples")
    answers = [evaluation.cross_validate(rows, TARGET, name, 0.5, SEED, 3).select(F.lit(name).alias("classifier"), "label", "prediction") for name in CLASSIFIERS]
    return metrics.beats_majority(metrics.scores(reduce(DataFrame.unionByName, answers), ["classifier"], TARGET))


_CODE_SQL = "100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10"
_RUN_LENGTHS, _RUN_CLASSIFIERS = ((3600, 3600), (3600, 7200)), ("logistic", "svm_linear")


def _code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by code."""
    return log(spark, sf_dir).filter("event_type = 'error'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT {_CODE_SQL} AS target_code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
g AS (SELECT target_code, pw, rw, classifier, n FROM c, (VALUES {", ".join(map(str, _RUN_LENGTHS))}) h(pw, rw), (VALUES {", ".join(f"('{x}')" for x in _RUN_CLASSIFIERS)}) k(classifier))
SELECT CAST(target_code AS BIGINT) AS target_code, CAST(pw AS BIGINT) AS pw, CAST(rw AS BIGINT) AS rw, classifier FROM g WHERE NOT (n > (SELECT avg(n) FROM c) AND rw = 3600)""")
def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every code of the log, horizon and classifier; codes above the average have their results of one horizon already."""
    counts = [(r["code"], r["n"]) for r in _code_counts(spark, sf_dir).orderBy("code").collect()]  # a row a code
    options = {"target_code": [c for c, _ in counts], "horizon": [Horizon(*h) for h in _RUN_LENGTHS], "classifier": list(_RUN_CLASSIFIERS)}
    runs = list(parameter_grid(options))
    often = {c for c, n in counts if n * len(counts) > sum(m for _, m in counts)}
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    done = [p for p in runs if p.target_code in often and p.horizon == Horizon(*_RUN_LENGTHS[0])]
    for p in done[:1]:
        stores.append_results(spark.range(2).select(F.rand(1).alias("accuracy")), path, run=grid.run_key(p, sf_dir))
    held = spark.createDataFrame([(grid.run_key(p, sf_dir), 0.5) for p in done], "run string, accuracy double")
    held.write.mode("append").parquet(path)
    return grid.pending(grid.runs_table(spark, runs, sf_dir), grid.stored_results(spark, path)).select("target_code", "pw", "rw", "classifier")


@query(f"""WITH c AS (SELECT {_CODE_SQL} AS code, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT CAST(code AS BIGINT) AS code, n, NULL::DOUBLE AS top, 'first' AS run, 3600 AS rw FROM c UNION ALL SELECT code, n, top, 'second', 7200 FROM c""")
def results_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two runs, the second with a further column, in one table of results."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    errors = log(spark, sf_dir).filter("event_type = 'error'").groupBy("code")
    stores.append_results(errors.agg(F.count(F.lit(1)).alias("n")), path, run="first", rw=3600)
    stores.append_results(errors.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")), path, run="second", rw=7200)
    return grid.stored_results(spark, path).filter("written_at IS NOT NULL").select("code", "n", "top", "run", "rw")


@query(f"""WITH c AS (SELECT {_CODE_SQL} AS item, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM events WHERE event_type = 'error') AS share FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT 'itemset' AS kind, CAST(item AS BIGINT) AS item, {sql_r6('share')} AS share FROM c UNION ALL SELECT 'rule', CAST(item AS BIGINT), {sql_r6('share')} FROM c WHERE n > 1 UNION ALL SELECT 'config', 1000, 0.5""")
def mining_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration, itemsets and rules as stored tables, read back."""
    path = f"{shared_dir(spark)}/mining-{uuid.uuid4().hex}"
    counts = _code_counts(spark, sf_dir).crossJoin(log(spark, sf_dir).filter("event_type = 'error'").agg(F.count(F.lit(1)).alias("total")))
    found = counts.select(F.col("code").alias("item"), r6(F.col("n") / F.col("total")).alias("share"), "n")
    stores.write_mining(path, MiningParams(), found.drop("n"), found.filter("n > 1").drop("n"))
    config = spark.read.parquet(f"{path}/config").select(F.lit("config").alias("kind"), F.col("window_len").alias("item"), F.col("support").alias("share"))
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(kind).alias("kind"), "item", "share") for kind, name in (("itemset", "fq_itemsets"), ("rule", "asc_rules"))]
    return reduce(DataFrame.unionByName, [*parts, config])

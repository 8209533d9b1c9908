"""Fitting, predicting and keeping models."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import TS
from tickloom.operators.labels import lags
from tickloom.operators.metrics import regression
from tickloom.operators.neighbours import nearest
from tickloom.operators.split import Folds, as_folds
from tickloom.plans import gram
from tickloom.session import cut_lineage

ESTIMATORS = {
    "linear": lambda **p: LinearRegression(**p),
    "ridge": lambda regParam=1.0, **p: LinearRegression(regParam=regParam, elasticNetParam=0.0, **p),
    "lasso": lambda regParam=1.0, **p: LinearRegression(regParam=regParam, elasticNetParam=1.0, **p),
    "elastic_net": lambda regParam=1.0, elasticNetParam=0.5, **p: LinearRegression(regParam=regParam, elasticNetParam=elasticNetParam, **p),
    "logistic": lambda **p: LogisticRegression(**p),
    "forest": lambda seed=42, **p: RandomForestRegressor(seed=seed, **p),
    "forest_classifier": lambda seed=42, **p: RandomForestClassifier(seed=seed, **p),
    "gbt": lambda seed=42, **p: GBTRegressor(seed=seed, **p),
    "gbt_classifier": lambda seed=42, **p: GBTClassifier(seed=seed, **p),
    "linear_svm": lambda **p: LinearSVC(**p),
}


def fit(df: DataFrame, cols: Sequence[str], label: str, kind: str = "linear", **params) -> PipelineModel:
    """Assemble the columns and fit; rows with a missing input or label take no part."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model {kind!r}; expected one of {sorted(ESTIMATORS)}")
    estimator = ESTIMATORS[kind](labelCol=label, featuresCol="features", **params)
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assembler, estimator]).fit(df.filter(F.col(label).isNotNull()))


def fit_with_early_stop(df: DataFrame, cols: Sequence[str], label: str, held_out: str, kind: str = "gbt", **params) -> PipelineModel:
    """Boosted trees that stop once the rows flagged by ``held_out`` no longer improve."""
    return fit(df, cols, label, kind, validationIndicatorCol=held_out, **params)


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """All rows with ``prediction`` and, for classifiers that give it, the probability of class 1; both are NULL where an input is missing."""
    assembler, out = model.stages[0].copy().setHandleInvalid("keep"), df
    for stage in (assembler, *model.stages[1:]):
        out = stage.transform(out)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in assembler.getInputCols()])
    keep = [F.col(c) for c in df.columns] + [F.when(whole, F.col("prediction")).alias(name)]
    if "probability" in out.columns:
        keep.append(F.when(whole, vector_to_array("probability")[1]).alias("probability"))
    return out.select(*keep)


def importance(spark: SparkSession, model: PipelineModel, cols: Sequence[str], method: str = "model") -> DataFrame:
    """(feature, method, score): impurity importance or absolute coefficient."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return spark.createDataFrame([(c, method, float(v)) for c, v in zip(cols, values)], "feature string, method string, score double")


def coefficients(spark: SparkSession, model: PipelineModel, cols: Sequence[str]) -> DataFrame:
    last = model.stages[-1]
    rows = [(c, float(v)) for c, v in zip(cols, last.coefficients.toArray())] + [("intercept", float(last.intercept))]
    return spark.createDataFrame(rows, "term string, coefficient double")


def save(model: PipelineModel, path: str, cols: Sequence[str], **metadata) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    text = json.dumps({"features": list(cols), **metadata}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def update(old: DataFrame, new: DataFrame, cols: Sequence[str], label: str, kind: str = "linear", **params) -> PipelineModel:
    """Refit on the old rows and the new ones."""
    return fit(old.unionByName(new, allowMissingColumns=True), cols, label, kind, **params)


def pca(df: DataFrame, cols: Sequence[str], k: int, keep: Sequence[str] = ("symbol", TS)) -> tuple[DataFrame, list[float]]:
    """Projection on ``k`` components of the centred columns, and their explained variance shares."""
    rows = df.select(*keep, *cols).dropna()
    means = rows.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = rows.withColumns({c: F.col(c) - means[c] for c in cols})
    assembled = VectorAssembler(inputCols=list(cols), outputCol="features").transform(centred)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(assembled)
    out = model.transform(assembled).withColumn("_pc", vector_to_array("_pc"))
    return out.select(*keep, *[F.col("_pc")[i].alias(f"pc_{i + 1}") for i in range(k)]), [float(v) for v in model.explainedVariance]


# --- closed-form least squares per key -----------------------------------------------------------
def least_squares(df: DataFrame, cols: Sequence[str], label: str, by: Sequence[str] = ("symbol",), ridge: float = 0.0) -> DataFrame:
    """(by..., term, coefficient) from the normal equations of each key.

    The rows reduce to means and covariances per key before the shuffle, so a key with a large
    share of the rows costs no more than another; one small system per key is then solved in Python.
    """
    names = [*cols, "intercept"]
    x = [F.col(c).cast("double") for c in cols]
    y = F.col(label).cast("double")
    rows = df.dropna(subset=[*cols, label])
    cov = F.array(*[F.covar_pop(a, b) for a in x for b in x], *[F.covar_pop(a, y) for a in x])
    packed = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"), cov.alias("_s"), F.array(*[F.avg(c) for c in [*x, y]]).alias("_m"))
    p = len(cols)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, s, m = float(row[-3]), np.asarray(row[-2], float), np.asarray(row[-1], float)
                gram, moment = s[: p * p].reshape(p, p) * n, s[p * p :] * n
                beta = np.linalg.lstsq(gram + ridge * np.eye(p), moment, rcond=None)[0]
                full = [*beta, m[-1] - float(beta @ m[:-1])]
                out += [(*row[: len(by)], t, float(b)) for t, b in zip(names, full)]
            yield pd.DataFrame(out, columns=[*by, "term", "coefficient"])

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return packed.mapInPandas(solve, f"{types}, term string, coefficient double" if by else "term string, coefficient double")


def autoregression(df: DataFrame, column: str, order: int, by: Sequence[str] = ("symbol",), keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """AR(p) coefficients of each series."""
    lagged = lags(df.select(*keys, TS, column), [column], range(1, order + 1), keys)
    return least_squares(lagged, [f"{column}_lag_{i}" for i in range(1, order + 1)], column, by)


# --- nearest neighbours --------------------------------------------------------------------------
def knn(train: DataFrame, query: DataFrame, cols: Sequence[str], label: str, key: str, k: int = 5, classify: bool = False) -> DataFrame:
    """Mean label of the nearest rows, or their most common label (the smallest on ties)."""
    near = nearest(train, query, cols, label, key, k)
    each = near.select(key, F.explode("neighbours.label").alias("label"))
    if not classify:
        return each.groupBy(key).agg(F.avg("label").alias("prediction"))
    votes = each.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(key).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))


# --- validation and search -----------------------------------------------------------------------
def roles_from_fold(df: DataFrame, folds: int) -> DataFrame:
    """Test on each fold and train on the others, as rows of (fold, role)."""
    each = df.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")


def fold_scores(folds: DataFrame | Folds, cols: Sequence[str], label: str, candidates: Sequence[dict], kind: str, parallelism: int = 4) -> dict[tuple[int, int], dict[str, float]]:
    """All metrics of each (candidate, fold), from rows stored once. A candidate may name its ``columns`` besides the model's parameters.

    Linear kinds are fitted from sums of products and scored together: two passes whatever the number of candidates. Other kinds are fitted on
    the folds' segments of the same table, several at a time.
    """
    folds = as_folds(folds).kept()
    jobs = [(i, k) for i in range(len(candidates)) for k in folds.roles]
    if kind in gram.LINEAR and all(set(c) <= {"regParam", "elasticNetParam", "columns"} for c in candidates):
        sums = gram.Moments(folds, cols, label)
        fits = {(i, k): (k, _fit_candidate(sums, folds, candidates[i], k, cols, kind)) for i, k in jobs}
        return gram.score_fits(folds, cols, label, fits)

    def one(job: tuple[int, int]) -> dict[str, float]:
        params = dict(candidates[job[0]])
        used = params.pop("columns", cols)
        scored = predict(fit(folds.train(job[1]), used, label, kind, **params), folds.test(job[1]))
        found = regression(scored, label, "prediction").first()
        return {m: float("nan") if found[m] is None else found[m] for m in gram.METRICS}

    with ThreadPool(parallelism) as pool:
        return dict(zip(jobs, pool.map(one, jobs), strict=True))


def _fit_candidate(sums: gram.Moments, folds: Folds, candidate: dict, fold: int, cols: Sequence[str], kind: str) -> gram.Fit:
    params = dict(candidate)
    used = [list(cols).index(c) for c in params.pop("columns", cols)]
    return gram.fit_sums(sums.over(folds.roles[fold][0]), used, kind, **params)


def cross_validate(folded: DataFrame | Folds, cols: Sequence[str], label: str, kind: str = "linear", name: str | None = None, parallelism: int = 4, **params) -> DataFrame:
    """(model, fold, metric, value) of a fit per fold. ``folded`` comes from a split operator."""
    folds = as_folds(folded)
    scores = fold_scores(folds, cols, label, [params], kind, parallelism)
    rows = [(name or kind, k, m, None if np.isnan(v[m]) else float(v[m])) for (_, k), v in sorted(scores.items()) for m in gram.METRICS]
    return folds.rows.sparkSession.createDataFrame(rows, "model string, fold int, metric string, value double")


def out_of_fold(folded: DataFrame | Folds, cols: Sequence[str], label: str, kinds: dict[str, tuple[str, dict]], keep: Sequence[str] = ("symbol", TS)) -> DataFrame:
    """(keep..., columns, label, model, prediction): each row predicted by models that did not see it.

    Linear models of all folds are one small table that the rows are joined with; of others each fold scores its own rows.
    """
    folds = as_folds(folded).kept()
    carried = list(dict.fromkeys([*keep, *cols]))
    rows = Folds(folds.rows.select("*", F.col(label).alias("_label")), folds.roles, True)
    linear = {n: v for n, v in kinds.items() if v[0] in gram.LINEAR and set(v[1]) <= {"regParam", "elasticNetParam"}}
    parts = []
    if linear:
        sums = gram.Moments(folds, cols, label)
        fits = {(n, k): _fit_candidate(sums, folds, params, k, cols, kind) for n, (kind, params) in linear.items() for k in folds.roles}
        parts.append(gram.predictions(rows, cols, fits, [*carried, "_label"]))
    for fold in folds.roles:
        for name, (kind, params) in kinds.items():
            if name not in linear:
                scored = predict(fit(folds.train(fold), cols, label, kind, **params), rows.test(fold))
                parts.append(scored.select(*carried, "_label", F.lit(name).alias("model"), "prediction"))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("_label", "label").select(*carried, "label", "model", "prediction")


def stack(folded: DataFrame | Folds, cols: Sequence[str], label: str, kinds: dict[str, tuple[str, dict]], with_features: bool = False, keep: Sequence[str] = ("symbol", TS), ridge: float = 0.0) -> tuple[PipelineModel, DataFrame]:
    """Linear model over out-of-fold predictions, and those predictions one column per model."""
    base = out_of_fold(folded, cols, label, kinds, keep)
    wide = cut_lineage(base.groupBy(*keep, "label", *cols).pivot("model", list(kinds)).agg(F.first("prediction")))
    inputs = [*kinds, *(cols if with_features else [])]
    return fit(wide, inputs, "label", "linear", regParam=ridge), wide


def stacking_weights(wide: DataFrame, models: Sequence[str], label: str = "label", ridge: float = 1.0) -> dict[str, float]:
    """Shares of the absolute ridge coefficients of each model's predictions."""
    model = fit(wide, models, label, "ridge", regParam=ridge)
    size = np.abs(model.stages[-1].coefficients.toArray())
    total = float(size.sum())
    return {m: float(s) / total if total else 1.0 / len(models) for m, s in zip(models, size)}


def grid(params: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(params, values)) for values in itertools.product(*params.values())]


def random_grid(params: dict[str, Sequence], draws: int, seed: int = 42) -> list[dict]:
    """A seeded draw without repeats from the grid."""
    every = grid(params)
    return random.Random(seed).sample(every, min(draws, len(every)))


def search(folded: DataFrame | Folds, cols: Sequence[str], label: str, kind: str, candidates: Sequence[dict], metric: str = "rmse", parallelism: int = 4) -> list[tuple[dict, float]]:
    """Candidates with their mean metric over the folds, best first; the earlier candidate among equals.

    Squared errors of linear kinds follow from the sums of products alone, so such a search reads the rows once however large it is.
    """
    folds = as_folds(folded).kept()
    if kind in gram.LINEAR and metric in ("rmse", "r2") and all(set(c) <= {"regParam", "elasticNetParam", "columns"} for c in candidates):
        sums = gram.Moments(folds, cols, label)
        tests = {k: sums.over(test) for k, (_, test) in folds.roles.items()}
        scores = {(i, k): _fit_candidate(sums, folds, c, k, cols, kind).errors(tests[k]) for i, c in enumerate(candidates) for k in folds.roles}
    else:
        scores = fold_scores(folds, cols, label, candidates, kind, parallelism)
    means = [float(np.nanmean([scores[i, k][metric] for k in folds.roles])) for i in range(len(candidates))]
    return sorted(zip(candidates, means, strict=True), key=lambda s: s[1], reverse=metric in ("r2", "direction_accuracy"))


def staged_search(folded: DataFrame | Folds, cols: Sequence[str], label: str, kind: str, stages: Sequence[dict[str, Sequence]], metric: str = "rmse") -> tuple[dict, float]:
    """Tune one group of parameters after another on one stored table, keeping the best of each stage."""
    folds, chosen, value = as_folds(folded).kept(), {}, float("nan")
    for stage in stages:
        (chosen, value), *_ = search(folds, cols, label, kind, [{**chosen, **c} for c in grid(stage)], metric)
    return chosen, value

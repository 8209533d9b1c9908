"""Feature selection that refits models."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import TS
from tickloom.operators.metrics import regression
from tickloom.operators.split import ROW, SEGMENT, Folds, as_folds, ordered
from tickloom.plans import gram
from tickloom.plans.models import fit, fold_scores, importance, predict
from tickloom.session import cut_lineage

KEY = ("symbol", TS)


#: Prime modulus and number of rounds of the bijection of positions.
PRIME, ROUNDS = 2_147_483_647, 4


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round, from the md5 of the seed and the round, so that any engine can follow them."""
    digests = [hashlib.md5(f"{seed}:{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [(int(d[:8], 16) % (PRIME - 1) + 1, int(d[8:16], 16) % PRIME) for d in digests]


def dealt(positions: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """A seeded bijection of 0 .. rows - 1.

    Positions are pairs of digits in a base whose square just covers the rows; each round adds a number drawn from
    the second digit to the first and swaps them. What falls outside is dealt again until it falls inside.
    """
    base = math.isqrt(max(rows - 1, 0)) + 1

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // base, x % base
        for a, b in round_keys(seed):
            drawn = (right * a + b) % PRIME
            left, right = right, (left + drawn * drawn % PRIME) % base
        return left * base + right

    out = once(positions.astype(np.int64))
    while (outside := out >= rows).any():
        out[outside] = once(out[outside])
    return out


def donors(df: DataFrame, repeats: int, seed: int, rows: int) -> DataFrame:
    """Rows ``_pos, _x, _y`` with, for each repeat, the columns of the row that the bijection names: ``_repeat, _d``."""

    @F.pandas_udf("array<bigint>")
    def named(positions: pd.Series) -> pd.Series:
        at = positions.to_numpy()
        return pd.Series(list(np.stack([dealt(at, rows, seed + r) for r in range(repeats)], axis=1))) if len(at) else pd.Series([], dtype=object)

    asked = df.select("_x", "_y", F.posexplode(named("_pos")).alias("_repeat", "_from"))
    return asked.join(df.select(F.col("_pos").alias("_from"), F.col("_x").alias("_d")), "_from").drop("_from")


def permutation_importance(model: PipelineModel, df: DataFrame, cols: Sequence[str], label: str, repeats: int = 10, seed: int = 42, key: Sequence[str] = KEY) -> DataFrame:
    """(feature, method, score, spread): rise of the squared error when a column takes the values of other rows.

    A repeat deals each row one donor row for all columns, so rows are fetched once a repeat; all variants of a
    row are scored in one pass, and the plan is the same for any number of columns.
    """
    usable = df.select(*key, *cols, label).filter(gram.finite([*cols, label]))
    numbered = ordered(usable, key[-1], list(key[:-1]))
    rows = cut_lineage(numbered.select(F.col(ROW).alias("_pos"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"), F.col(label).cast("double").alias("_y")))
    last = model.stages[-1].copy()

    def errors(scored: DataFrame, by: Sequence[str]) -> DataFrame:
        vectors = scored.withColumn(last.getFeaturesCol(), array_to_vector("_x"))
        return last.transform(vectors).groupBy(*by).agg(F.avg(F.pow(F.col("_y") - F.col("prediction"), 2)).alias("_mse"))

    base = errors(rows, []).first()["_mse"]
    variants = donors(rows, repeats, seed, rows.count()).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))))
    changed = variants.withColumn("_x", F.expr("transform(_x, (v, i) -> IF(i = _c, _d[i], v))"))
    names = F.array(*[F.lit(c) for c in cols])
    rises = errors(changed, ["_c", "_repeat"]).select(names[F.col("_c")].alias("feature"), (F.col("_mse") - F.lit(base)).alias("rise"))
    return rises.groupBy("feature").agg(F.lit("permutation").alias("method"), F.avg("rise").alias("score"), F.stddev_pop("rise").alias("spread"))


def recursive_elimination(df: DataFrame, cols: Sequence[str], label: str, keep: int = 1, kind: str = "forest", **params) -> DataFrame:
    """(feature, method, score, round): drop the least important column until ``keep`` remain.

    The score is 1 / rank, the kept columns sharing rank 1.
    """
    rows = cut_lineage(df.select(*cols, label).dropna())
    if kind in gram.LINEAR and set(params) <= {"regParam", "elasticNetParam"}:
        whole = Folds(rows.withColumn(SEGMENT, F.lit(0)), {0: ((0,), (0,))}, True)
        order = gram.eliminated(gram.Moments(whole, cols, label).over([0]), cols, kind, **params)
        ranked = {c: max(1, i - keep + 2) for i, c in enumerate(order)}
        return rows.sparkSession.createDataFrame([(c, "elimination", 1.0 / r, r) for c, r in ranked.items()], "feature string, method string, score double, rank int")
    left, dropped = list(cols), []
    while len(left) > keep:
        model = fit(rows, left, label, kind, **params)
        weakest = importance(rows.sparkSession, model, left).orderBy("score", F.col("feature").desc()).first()["feature"]
        left.remove(weakest)
        dropped.append(weakest)
    ranks = {c: 1 for c in left} | {c: len(dropped) - i + 1 for i, c in enumerate(dropped)}
    return rows.sparkSession.createDataFrame([(c, "elimination", 1.0 / r, r) for c, r in ranks.items()], "feature string, method string, score double, rank int")


def _curve(spark: SparkSession, values: dict[tuple[int, int], dict[str, float]]) -> DataFrame:
    """(features, metric, mean, std) over the folds, from metrics by (features, fold)."""
    out = []
    for k in sorted({k for k, _ in values}):
        for m in gram.METRICS:
            own = [v[m] for (size, _), v in sorted(values.items()) if size == k and not np.isnan(v[m])]
            out.append((k, m, float(np.mean(own)) if own else None, float(np.std(own)) if own else None))
    return spark.createDataFrame(out, "features int, metric string, mean double, std double")


def _nested_scores(folds: Folds, orders: dict[int, Sequence[str]], label: str, sizes: Sequence[int], kind: str, **params) -> dict[tuple[int, int], dict[str, float]]:
    """Metrics by (features, fold) on the first columns of each fold's own order.

    A linear fit on one column more is one more sweep, so all sizes of all folds take two passes over the rows.
    """
    cols = sorted({c for order in orders.values() for c in order})
    if kind in ("linear", "ridge") and set(params) <= {"regParam"}:
        sums, fits = gram.Moments(folds, cols, label), {}
        for fold, order in orders.items():
            nested = gram.nested_fits(sums.over(folds.roles[fold][0]), [cols.index(c) for c in order], params.get("regParam", 1.0 if kind == "ridge" else 0.0))
            fits |= {(k, fold): (fold, nested[k - 1]) for k in sizes}
        return gram.score_fits(folds, cols, label, fits)
    out = {}
    for fold, order in orders.items():
        own = Folds(folds.rows, {fold: folds.roles[fold]}, True)
        scores = fold_scores(own, list(order), label, [{**params, "columns": list(order[:k])} for k in sizes], kind)
        out |= {(sizes[i], f): v for (i, f), v in scores.items()}
    return out


def subset_curve(folded: DataFrame | Folds, order: Sequence[str], label: str, sizes: Sequence[int], kind: str = "linear", **params) -> DataFrame:
    """(features, metric, mean, std) of cross-validation on the first k columns of ``order``."""
    folds = as_folds(folded).kept()
    return _curve(folds.rows.sparkSession, _nested_scores(folds, dict.fromkeys(folds.roles, list(order)), label, list(sizes), kind, **params))


def elimination_with_folds(folded: DataFrame | Folds, cols: Sequence[str], label: str, kind: str = "forest", metric: str = "rmse", **params) -> tuple[list[str], DataFrame]:
    """Columns of the best number of features, and the whole curve.

    Each fold eliminates on its own training rows, so its test rows have no part in the order they judge. The number
    with the best mean is then taken from an elimination over all rows of the last fold. Linear kinds eliminate on sums of products.
    """
    folds, cols = as_folds(folded).kept(), list(cols)
    last = max(folds.roles)
    whole = (*folds.roles[last][0], *folds.roles[last][1])
    if kind in gram.LINEAR and set(params) <= {"regParam", "elasticNetParam"}:
        sums = gram.Moments(folds, cols, label)
        order_on = lambda segments: gram.eliminated(sums.over(segments), cols, kind, **params)
    else:

        def order_on(segments: Sequence[int]) -> list[str]:
            ranks = {r["feature"]: r["rank"] for r in recursive_elimination(folds.part(segments), cols, label, 1, kind, **params).collect()}
            return sorted(cols, key=lambda c: (ranks[c], c))

    orders = {fold: order_on(train) for fold, (train, _) in folds.roles.items()}
    curve = _curve(folds.rows.sparkSession, _nested_scores(folds, orders, label, range(1, len(cols) + 1), kind, **params))
    ascending = metric not in ("r2", "direction_accuracy")
    best = curve.filter(F.col("metric") == metric).orderBy(F.col("mean").asc() if ascending else F.col("mean").desc(), "features").first()["features"]
    return order_on(whole)[:best], curve


def retrain_selected(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, kind: str = "gbt", **params) -> tuple[PipelineModel, DataFrame]:
    """Model on the chosen columns and its metrics on the held-out rows."""
    model = fit(train, cols, label, kind, **params)
    return model, regression(predict(model, test), label).withColumn("features", F.lit(len(cols)))

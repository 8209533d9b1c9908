"""Regression and classification metrics as aggregates over prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ranks import average_ranks, value_counts


def regression(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MSE, MAE, R2 and direction accuracy; rows without a label or prediction are ignored."""
    y, p = F.col(label), F.col(prediction)
    valid = df.filter(y.isNotNull() & p.isNotNull())
    mse = F.avg(F.pow(y - p, 2))
    return valid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("direction_accuracy"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    valid = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return valid.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs as label or prediction."""
    cells = confusion(df, label, prediction, by)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    long = cells.select(*by, F.explode(sides).alias("e"), hit.alias("_hit")).select(*by, "e.*", F.when(F.col("e.support") > 0, F.col("_hit")).otherwise(0).alias("hit"))
    per = long.groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("predicted").cast("double")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support").cast("double")), zero)
    out = per.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return out.withColumn("f1", f1)


def classification(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    report = class_report(df, label, prediction, by)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return report.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        (F.sum("hit").cast("double") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
    )


def binary(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of one class."""
    return class_report(df, label, prediction, by).filter(F.col("class") == positive).select(*by, "precision", "recall", "f1")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve from average ranks; NULL when one class is absent."""
    valid = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("_y", F.col(label).cast("long"))
    ranks = average_ranks(value_counts(valid, by, score, extra=[F.sum("_y").alias("_pos")]))
    pos = F.sum("_pos").cast("double")
    neg = F.max("_n") - pos
    area = F.sum(F.col("_pos") * F.col("_rank")) - pos * (pos + 1) / 2
    return ranks.groupBy(*by).agg(F.try_divide(area, pos * neg).alias("auc"))


def compare(metrics: DataFrame, by: str = "model", names: Sequence[str] | None = None) -> DataFrame:
    """Long (model, metric, value) to one row per model."""
    return metrics.groupBy(by).pivot("metric", list(names) if names else None).agg(F.first("value"))


def fold_summary(metrics: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Mean and both deviations of each metric over the folds."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"), F.stddev_samp("value").alias("std"), F.count("value").alias("folds"))


def best(metrics: DataFrame, metric: str, lowest: bool = True) -> DataFrame:
    order = F.col("value").asc() if lowest else F.col("value").desc()
    return metrics.filter(F.col("metric") == metric).withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(order, "model")))

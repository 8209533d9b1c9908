"""Combining and smoothing predictions held in long form: (symbol, ts, model, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import TS
from tickloom.operators.scan import Scan, scan
from tickloom.operators.series import rolling, trailing

KEY = ("symbol", TS)


def weight_of(weights: dict[str, float]) -> Column:
    """Weight of the row's model, scaled so that all weights sum to 1."""
    total = sum(weights.values())
    if total == 0:
        raise ValueError("weights sum to zero")
    return F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, w / total)])[F.col("model")]


def average(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.avg("prediction").alias("prediction"))


def weighted(df: DataFrame, weights: dict[str, float], key: Sequence[str] = KEY) -> DataFrame:
    w = F.when(F.col("prediction").isNotNull(), weight_of(weights))
    return df.groupBy(*key).agg(F.try_divide(F.sum(w * F.col("prediction")), F.sum(w)).alias("prediction"))


def median(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """A key holds one row per model, so the exact percentile buffers that many values."""
    return df.groupBy(*key).agg(F.median("prediction").alias("prediction"))


def sign_vote(df: DataFrame, threshold: float = 0.0, key: Sequence[str] = KEY) -> DataFrame:
    vote = F.when(F.col("prediction") > threshold, 1).when(F.col("prediction").isNotNull(), -1)
    return df.groupBy(*key).agg(F.when(F.sum(vote) > 0, 1).otherwise(-1).alias("prediction"))


def threshold_vote(df: DataFrame, weights: dict[str, float], cut: float = 0.5, key: Sequence[str] = KEY) -> DataFrame:
    """1 when models of more than half the weight predict above ``cut``."""
    up = F.when(F.col("prediction") > cut, 1.0).otherwise(0.0)
    return df.groupBy(*key).agg((F.sum(weight_of(weights) * up) > 0.5).cast("int").alias("prediction"))


def soft_vote(df: DataFrame, weights: dict[str, float], key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg((F.sum(weight_of(weights) * F.col("prediction")) > 0.5).cast("int").alias("prediction"))


def majority(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Most frequent label, the smallest one on ties."""
    counts = df.filter(F.col("prediction").isNotNull()).groupBy(*key, "prediction").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key).agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("prediction"))


def inverse_error_weights(errors: DataFrame, error: str = "error", by: Sequence[str] = ()) -> DataFrame:
    """Weights proportional to 1/error; one row per model (and per ``by``)."""
    inverse = 1.0 / F.greatest(F.col(error), F.lit(1e-10))
    return errors.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(*by)))


def dynamic_weights(df: DataFrame, label: str = "label", updates: int = 20) -> DataFrame:
    """Weights at each time from each model's mean squared error over its last ``updates`` rows."""
    errors = df.withColumn("_e", F.pow(F.col(label) - F.col("prediction"), 2))
    out = rolling(errors, [lambda w: {"error": F.avg("_e").over(trailing(w, updates))}], back=updates, keys=["symbol", "model"], drop=("_e",))
    return inverse_error_weights(out, "error", KEY)


def smooth_trailing(df: DataFrame, window: int, column: str = "prediction", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean of the rows so far, at most ``window`` of them."""
    return rolling(df, [lambda w: {"smoothed": F.avg(column).over(trailing(w, window))}], back=window, keys=keys)


def _centred(w, window: int):
    ahead = (window - 1) // 2
    return w.rowsBetween(-(window - 1 - ahead), ahead)


def smooth_centred(df: DataFrame, window: int, how: str = "mean", column: str = "prediction", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean or median around each row, over what exists at the edges. It reads later rows."""

    def level(w):
        frame = _centred(w, window)
        if how == "mean":
            return {"smoothed": F.avg(column).over(frame)}
        values = F.sort_array(F.collect_list(column).over(frame))
        n = F.size(values)
        middle = (F.try_element_at(values, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(values, F.floor((n + 2) / 2).cast("int"))) / 2
        return {"smoothed": F.when(n > 0, middle)}

    if how not in ("mean", "median"):
        raise ValueError(f"how must be 'mean' or 'median', got {how!r}")
    return rolling(df, [level], back=window, ahead=window, keys=keys)


def smooth_symmetric(df: DataFrame, window: int, column: str = "prediction", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean over ``window // 2`` rows on either side."""
    half = window // 2
    return rolling(df, [lambda w: {"smoothed": F.avg(column).over(w.rowsBetween(-half, half))}], back=half, ahead=half, keys=keys)


def smooth_ewm(df: DataFrame, window: int, adjusted: bool = False, column: str = "prediction", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return scan(df, [Scan("smoothed", F.col(column), 2.0 / (window + 1), adjusted=adjusted)], keys)

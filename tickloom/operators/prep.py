"""Outlier treatment and scaling, fitted on one table and applied to any."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import KEYS
from tickloom.operators.clean import fill_forward, fill_zero
from tickloom.operators.ranks import long_form, quantiles

Stats = dict[str, dict[str, float]]


def fit_stats(df: DataFrame, cols: Sequence[str], quartiles: bool = False) -> Stats:
    """Per-column statistics; the result has one entry per column, never per row."""
    v = F.col("value")
    long = long_form(df, cols)
    table = long.groupBy("feature").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    if quartiles:
        table = table.join(F.broadcast(quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})), "feature", "left")
    return {r["feature"]: r.asDict() for r in table.collect()}


def clip_iqr(df: DataFrame, stats: Stats, width: float = 1.5) -> DataFrame:
    out = {}
    for c, s in stats.items():
        spread = s["q3"] - s["q1"]
        out[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(s["q1"] - width * spread)), F.lit(s["q3"] + width * spread)))
    return df.withColumns(out)


def mask_zscore(df: DataFrame, stats: Stats, limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` deviations from the mean become the mean."""
    return df.withColumns(
        {c: F.when(F.abs(F.col(c) - s["mean"]) > limit * s["std"], F.lit(s["mean"])).otherwise(F.col(c)) for c, s in stats.items() if s["std"]}
    )


def _rescale(df: DataFrame, stats: Stats, centre: str, width) -> DataFrame:
    """A constant column is only centred."""
    return df.withColumns({c: (F.col(c) - s[centre]) / (width(s) or 1.0) for c, s in stats.items() if s[centre] is not None})


def scale_standard(df: DataFrame, stats: Stats) -> DataFrame:
    return _rescale(df, stats, "mean", lambda s: s["std_pop"])


def scale_minmax(df: DataFrame, stats: Stats) -> DataFrame:
    return _rescale(df, stats, "min", lambda s: s["max"] - s["min"])


def scale_robust(df: DataFrame, stats: Stats) -> DataFrame:
    return _rescale(df, stats, "median", lambda s: s["q3"] - s["q1"])


SCALERS = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust}


@dataclass
class Preprocessor:
    """Fill, outlier treatment, then scaling; statistics come from the training rows only."""

    cols: Sequence[str]
    fill: str | None = "forward"
    outliers: str | None = "iqr"
    scaling: str | None = "standard"
    keys: Sequence[str] = KEYS
    _fill_stats: Stats = field(default_factory=dict)
    _clip_stats: Stats = field(default_factory=dict)
    _scale_stats: Stats = field(default_factory=dict)

    def _filled(self, df: DataFrame) -> DataFrame:
        if self.fill == "forward":
            df = fill_forward(df, self.cols, self.keys)
        elif self.fill == "mean":
            df = df.fillna({c: s["mean"] for c, s in self._fill_stats.items() if s["mean"] is not None})
        elif self.fill == "zero":
            df = fill_zero(df, self.cols)
        return df

    def _treated(self, df: DataFrame) -> DataFrame:
        if self.outliers == "iqr":
            df = clip_iqr(df, self._clip_stats)
        elif self.outliers == "zscore":
            df = mask_zscore(df, self._clip_stats)
        return df.fillna(0.0, list(self.cols))

    def fit(self, train: DataFrame) -> Preprocessor:
        self._fill_stats = fit_stats(train, self.cols) if self.fill == "mean" else {}
        filled = self._filled(train)
        self._clip_stats = fit_stats(filled, self.cols, quartiles=self.outliers == "iqr") if self.outliers else {}
        self._scale_stats = fit_stats(self._treated(filled), self.cols, quartiles=self.scaling == "robust") if self.scaling else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._treated(self._filled(df))
        return SCALERS[self.scaling](out, self._scale_stats) if self.scaling else out

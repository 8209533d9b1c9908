"""Training on columns of several bar sizes as one path: features of each size, as-of, targets, split, fit, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import CROSS_TIMEFRAME_FEATURES, KEYS, TS, FeatureConfig, horizon_rows
from tickloom.functions import volume
from tickloom.functions.core import compute
from tickloom.operators import align, split
from tickloom.operators.labels import targets
from tickloom.operators.metrics import regression
from tickloom.plans.features import compute_features
from tickloom.plans.models import fit, predict
from tickloom.session import cut_lineage


def _features(bars: DataFrame, wanted: Sequence[str], config: FeatureConfig | None) -> DataFrame:
    """The feature table and, where asked for, the on-balance volume, which no feature group has."""
    out = compute_features(bars, config)
    return compute(out, volume.cumulative(("OBV",))) if "OBV" in wanted and "OBV" not in out.columns else out


def cross_timeframe_table(
    bars: Mapping[str, DataFrame],
    base: str = "1h",
    columns: Mapping[str, Sequence[str]] = CROSS_TIMEFRAME_FEATURES,
    horizons: Sequence[int] | None = None,
    config: FeatureConfig | None = None,
    available: bool = True,
    volatility: bool = True,
) -> DataFrame:
    """Rows of the base size with the chosen feature columns of every size (``1h_...``, ``4h_...``) and the base size's forward targets.

    A coarse bar is seen from its close on. Horizons default to the configured minutes in whole bars of the base size. A column that a size
    does not have is an error.
    """
    features = {tf: _features(table, columns.get(tf, []), config) for tf, table in bars.items()}
    for tf, table in features.items():
        unknown = [c for c in columns.get(tf, []) if c not in table.columns]
        if unknown:
            raise ValueError(f"no columns {unknown} at {tf}")
    joined = align.integrate(features, base, {tf: list(columns.get(tf, [])) for tf in bars}, available)
    rows = list(horizons) if horizons is not None else horizon_rows(base)
    labelled = targets(bars[base].select(*KEYS, TS, "close"), rows, volatility=volatility)
    return labelled.drop("timeframe", "close").join(joined, ["symbol", TS])


def filled_columns(table: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that have a value in some row; long windows of coarse bars have none in a short history."""
    some = table.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in cols]).first()
    return [c for c in cols if some[c]]


def train_cross_timeframe(table: DataFrame, label: str, kind: str = "linear", train: float = 0.7, validation: float = 0.15, **params) -> tuple[PipelineModel, list[str], DataFrame]:
    """Model, its columns and its metrics on the last rows. Rows that lack a column or the label take no part."""
    cols = [c for c in table.columns if not c.startswith("target_") and c not in ("symbol", TS)]
    rows = cut_lineage(table.select("symbol", TS, *cols, label))
    cols = filled_columns(rows.filter(F.col(label).isNotNull()), cols)
    parts = cut_lineage(split.chronological(rows.select("symbol", TS, *cols, label).dropna(), train, validation))
    model = fit(parts.filter("split = 'train'"), cols, label, kind, **params)
    return model, cols, regression(predict(model, parts.filter("split = 'test'")), label)

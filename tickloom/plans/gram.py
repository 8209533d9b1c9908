"""Linear models from sums of products, so that any number of folds, columns and penalties costs one pass over the rows.

Rows belong to segments (``split.Folds``). One pass adds up, for each segment, the products of columns and label; what a fold
trains or is tested on is a sum of segments. Least squares and ridge fits come from sweeping these small matrices,
lasso and elastic net from coordinate descent on them. Penalties are those of MLlib: on columns and label scaled to a deviation of one, with the
penalty divided by the label's deviation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.split import SEGMENT, Folds

#: Kinds of models that these sums fit.
LINEAR = ("linear", "ridge", "lasso", "elastic_net")
METRICS = ("rmse", "mae", "r2", "direction_accuracy")
#: Part of a column's variance below which it adds nothing to the columns swept in.
TOLERANCE = 1e-12


def finite(cols: Sequence[str]) -> Column:
    """Rows in which every column has a number."""
    out = F.lit(True)
    for c in cols:
        out &= F.abs(F.col(c).cast("double")) < float("inf")
    return out


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


@dataclass
class Sums:
    """Count, mean and population covariance of the columns, the label last."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @property
    def spread(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))


class Moments:
    """Sums of every segment of the rows, for ``cols`` and then ``label``."""

    def __init__(self, folds: Folds, cols: Sequence[str], label: str):
        self.cols, names = list(cols), [*cols, label]
        rows = folds.rows.filter(finite(names))
        centre = [m or 0.0 for m in rows.agg(*[F.avg(F.col(c).cast("double")) for c in names]).first()]
        values = F.array(*[F.col(c).cast("double") - m for c, m in zip(names, centre, strict=True)]).alias("v")
        p = len(names)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x, at = np.c_[np.ones(batch.num_rows), _matrix(batch, 1, p)], batch.column(0).to_numpy()
                for s in np.unique(at):
                    own = x[at == s]
                    total[int(s)] = total.get(int(s), 0.0) + own.T @ own
            cells = [(s, i, j, float(m[i, j])) for s, m in total.items() for i in range(p + 1) for j in range(i, p + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(("s", "i", "j", "v"), c)) for c in cells], schema=pa.schema([("s", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

        parts = rows.select(SEGMENT, values).mapInArrow(run, "s int, i int, j int, v double")
        self.centre, self.sums = np.array(centre), {}
        for r in parts.groupBy("s", "i", "j").agg(F.sum("v").alias("v")).collect():  # segments x columns squared
            own = self.sums.setdefault(r["s"], np.zeros((p + 1, p + 1)))
            own[r["i"], r["j"]] = own[r["j"], r["i"]] = r["v"]

    def over(self, segments: Sequence[int]) -> Sums:
        total = sum((self.sums[s] for s in segments if s in self.sums), np.zeros((len(self.cols) + 2,) * 2))
        n = total[0, 0]
        if n == 0:
            return Sums(0.0, self.centre, np.zeros_like(total[1:, 1:]))
        off = total[0, 1:] / n
        return Sums(n, self.centre + off, total[1:, 1:] / n - np.outer(off, off))


def sweep(a: np.ndarray, k: int) -> bool:
    """Bring row and column ``k`` of a symmetric matrix into the regression, in place; False where it adds nothing."""
    d = a[k, k]
    if d < TOLERANCE:
        return False
    row = a[k].copy()
    a -= np.outer(row, row) / d
    a[k], a[:, k] = row / d, row / d
    a[k, k] = -1.0 / d
    return True


@dataclass
class Fit:
    """Coefficients of all columns (0 for those left out) and the intercept."""

    beta: np.ndarray
    intercept: float

    def errors(self, test: Sums) -> dict[str, float]:
        """Metrics that the sums of the test rows give."""
        if test.n == 0:
            return {"mse": float("nan"), "rmse": float("nan"), "r2": float("nan")}
        w = np.append(-self.beta, 1.0)
        mse = float(max(w @ test.cov @ w, 0.0) + (w @ test.mean - self.intercept) ** 2)
        var = float(test.cov[-1, -1])
        return {"mse": mse, "rmse": mse**0.5, "r2": 1 - mse / var if var > 0 else float("nan")}


def scaled(train: Sums, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Correlations with the penalty on the diagonal of the columns, and the deviations (0 for constant columns)."""
    s = train.spread
    size = np.where(s > 1e-12 * (np.abs(train.mean) + s), s, 0.0)
    inverse = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    a = train.cov * np.outer(inverse, inverse)
    if size[-1] > 0:
        a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += penalty / size[-1] * (size[:-1] > 0)
    return a, size


def _unscaled(train: Sums, size: np.ndarray, w: np.ndarray) -> Fit:
    beta = np.divide(w * size[-1], size[:-1], out=np.zeros_like(w), where=size[:-1] > 0)
    return Fit(beta, float(train.mean[-1] - beta @ train.mean[:-1]))


def nested_fits(train: Sums, order: Sequence[int], penalty: float = 0.0) -> list[Fit]:
    """Fits on the first 1, 2, ... columns of ``order``, each one sweep after the one before."""
    a, size = scaled(train, penalty)
    out, taken = [], []
    for k in order:
        if sweep(a, k):
            taken.append(k)
        w = np.zeros(len(train.mean) - 1)
        w[taken] = a[taken, -1]
        out.append(_unscaled(train, size, w))
    return out


def fit_sums(train: Sums, columns: Sequence[int], kind: str = "linear", regParam: float | None = None, elasticNetParam: float | None = None) -> Fit:
    """Fit of one kind on the given columns."""
    penalty = (0.0 if kind == "linear" else 1.0) if regParam is None else regParam
    share = {"lasso": 1.0, "elastic_net": 0.5}.get(kind, 0.0) if elasticNetParam is None else elasticNetParam
    if not len(columns) or train.n == 0:
        return Fit(np.zeros(len(train.mean) - 1), float(train.mean[-1]))
    if share == 0 or penalty == 0:
        return nested_fits(train, columns, penalty)[-1]
    a, size = scaled(train, penalty * (1 - share))
    w, level = np.zeros(len(a) - 1), penalty * share / size[-1] if size[-1] > 0 else 0.0
    for _ in range(100_000):
        moved = 0.0
        for k in columns:
            if size[k] > 0 and size[-1] > 0:
                pull = a[k, -1] - a[k, :-1] @ w + a[k, k] * w[k]
                new = np.sign(pull) * max(abs(pull) - level, 0.0) / a[k, k]
                moved = max(moved, abs(new - w[k]))
                w[k] = new
        if moved < 1e-13:
            break
    return _unscaled(train, size, w)


def eliminated(train: Sums, columns: Sequence[str], kind: str = "linear", **params) -> list[str]:
    """Columns from the last one left to the first one dropped: the smallest coefficient goes, the later name among equals."""
    left, dropped = list(range(len(columns))), []
    while len(left) > 1:
        beta = fit_sums(train, left, kind, **params).beta
        weakest = min(sorted(left, key=lambda k: columns[k], reverse=True), key=lambda k: abs(beta[k]))
        left.remove(weakest)
        dropped.append(weakest)
    return [columns[k] for k in [*left, *reversed(dropped)]]


def score_fits(folds: Folds, cols: Sequence[str], label: str, fits: Mapping[tuple, tuple[int, Fit]]) -> dict[tuple, dict[str, float]]:
    """All metrics of each fit (name to fold and fit) on the test rows of its fold, in one pass over the rows."""
    names, keys = [*cols, label], list(fits)
    rows = folds.rows.filter(finite(names)).select(SEGMENT, F.array(*[F.col(c).cast("double") for c in names]).alias("v"))
    beta = np.array([[*fits[k][1].beta, fits[k][1].intercept] for k in keys])
    tests = {s: np.array([i for i, k in enumerate(keys) if s in folds.roles[fits[k][0]][1]], int) for s in {s for _, t in folds.roles.values() for s in t}}
    p, fields = len(names), ("n", "y", "yy", "se", "ae", "same")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros((len(keys), len(fields)))
        for batch in batches:
            v, at = _matrix(batch, 1, p), batch.column(0).to_numpy()
            for s in np.unique(at):
                which = tests.get(int(s))
                if which is None or not len(which):
                    continue
                x, y = np.c_[v[at == s][:, :-1], np.ones((at == s).sum())], v[at == s][:, -1:]
                for start in range(0, len(which), 64):  # bounded memory for many fits
                    some = which[start : start + 64]
                    e = y - x @ beta[some].T
                    same = np.sign(y) == np.sign(y - e)
                    total[some] += np.c_[np.full(len(some), len(y)), np.full(len(some), y.sum()), np.full(len(some), (y * y).sum()), (e * e).sum(0), np.abs(e).sum(0), same.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys)), pa.int32()), *[pa.array(total[:, i]) for i in range(len(fields))]], names=["k", *fields])

    sums = rows.mapInArrow(run, "k int, " + ", ".join(f"{f} double" for f in fields)).groupBy("k").agg(*[F.sum(f).alias(f) for f in fields])
    out = {k: dict.fromkeys(METRICS, float("nan")) for k in keys}
    for r in sums.collect():  # one row a fit
        n = r["n"]
        if n:
            mse, var = r["se"] / n, max(r["yy"] / n - (r["y"] / n) ** 2, 0.0)
            out[keys[r["k"]]] = {"rmse": mse**0.5, "mae": r["ae"] / n, "r2": 1 - mse / var if var > 0 else float("nan"), "direction_accuracy": r["same"] / n}
    return out


def predictions(folds: Folds, cols: Sequence[str], fits: Mapping[tuple[str, int], Fit], keep: Sequence[str]) -> DataFrame:
    """(keep..., model, prediction): each row once for each model, by the fit of the fold that tests it. ``fits`` maps (model, fold) to a fit.

    The fits are a table of one row a segment and model, which Spark joins by the segment.
    """
    table = [(s, name, [float(b) for b in fit.beta], fit.intercept) for (name, fold), fit in fits.items() for s in folds.roles[fold][1]]
    fitted = folds.rows.sparkSession.createDataFrame(table, f"{SEGMENT} int, model string, _beta array<double>, _b double")
    x = F.array(*[F.col(c).cast("double") for c in cols])
    total = F.aggregate(F.zip_with(x, "_beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    rows = folds.rows.filter(finite(cols)).join(F.broadcast(fitted), SEGMENT)
    return rows.select(*keep, "model", (total + F.col("_b")).alias("prediction"))

"""Signals, positions, returns and trade tables of a thresholded prediction strategy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import TS
from tickloom.operators.series import CHUNK, CHUNK_ROWS, HALO, POS, chunks, positions, rolling, running
from tickloom.session import cut_lineage

SERIES = ("symbol",)


def entry_signals(df: DataFrame, prediction: str = "prediction", threshold: str | float = 0.5, memory: int = 5, keys: Sequence[str] = SERIES) -> DataFrame:
    """+1/-1 where the previous bar's prediction passes the threshold and the recent mean agrees.

    The threshold is never below 0.5. Predictions before the first count as zero in the mean.
    """
    limit = F.greatest(F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold)), F.lit(0.5))

    def first(w):
        return {"_p": F.coalesce(F.lag(prediction).over(w), F.lit(0.0))}

    def second(w):
        mean = F.sum("_p").over(w.rowsBetween(-(memory - 1), 0)) / memory
        p = F.col("_p")
        return {"signal": F.when((p > limit) & (mean > 0), 1).when((p < -limit) & (mean < 0), -1).otherwise(0)}

    return rolling(df, [first, second], back=memory + 1, keys=keys, drop=("_p",))


def confirmed(signals: DataFrame, needed: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """Signal rows that follow at least ``needed - 1`` signals of the same direction."""

    def level(w):
        same = F.lit(True)
        for k in range(1, needed):
            same = same & F.coalesce(F.lag("signal", k).over(w) == F.col("signal"), F.lit(False))
        return {"_same": same}

    out = rolling(signals.filter(F.col("signal") != 0).select(*keys, TS, "signal"), [level], back=needed, keys=keys)
    return out.filter("_same").select(*keys, TS, F.col("signal").alias("direction"))


def positions_held(signals: DataFrame, needed: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """Direction of the last confirmed signal, 0 before the first.

    The signals are read by both sides of the join and again by the running pass, so they are
    stored once.
    """
    signals = cut_lineage(signals)
    marked = signals.join(confirmed(signals, needed, keys), [*keys, TS], "left")
    out = running(marked, {"position": ("last", F.col("direction"))}, keys)
    return out.withColumn("position", F.coalesce("position", F.lit(0))).drop("direction")


def net_returns(df: DataFrame, price: str = "close", fee: str | float = 0.001, slippage: float = 0.0005, leverage: str | float = 1.0, keys: Sequence[str] = SERIES) -> DataFrame:
    """Return of the position held over the bar, less the cost of changing it."""
    cost = (F.col(fee) if isinstance(fee, str) else F.lit(fee)) + slippage
    lever = F.col(leverage) if isinstance(leverage, str) else F.lit(leverage)

    def level(w):
        change = F.try_divide(F.col(price), F.lag(price).over(w)) - 1
        held = F.coalesce(F.lag("position").over(w), F.lit(0))
        return {"net_return": held * F.coalesce(change, F.lit(0.0)) * lever - F.abs(F.col("position") - held) * cost}

    return rolling(df, [level], back=1, keys=keys)


def equity(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Growth, its peak so far and the drawdown. A loss of everything leaves nothing: growth is 0."""
    df = cut_lineage(df)
    alive = F.when(F.col("net_return") > -1, F.log1p("net_return"))
    gone = (F.col("net_return") <= -1).cast("int")
    out = running(df, {"_log": ("sum", alive), "_gone": ("max", gone)}, keys)
    out = out.withColumn("equity", F.when(F.col("_gone") == 1, 0.0).otherwise(F.exp(F.coalesce("_log", F.lit(0.0)))))
    out = running(out.drop("_log", "_gone"), {"peak": ("max", F.col("equity"))}, keys)
    return out.withColumn("drawdown", F.try_divide(F.col("equity"), F.col("peak")) - 1)


def summary(df: DataFrame, by: Sequence[str] = SERIES, periods_per_year: float = 252.0, risk_free: float = 0.01) -> DataFrame:
    """Annual return and volatility, Sharpe ratio, worst drawdown and final growth, all as fractions."""
    mean, std = F.avg("net_return"), F.stddev_samp("net_return")
    yearly, vol = mean * periods_per_year, std * periods_per_year**0.5
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bars"),
        (F.max_by("equity", TS) - 1).alias("total_return"),
        yearly.alias("annual_return"),
        vol.alias("annual_volatility"),
        F.coalesce(F.try_divide(yearly - risk_free, vol), F.lit(0.0)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )


def trades(df: DataFrame, price: str = "close", long_only: bool = False, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per closed trade. ``long_only`` opens above zero and closes at exactly zero.

    Rows where nothing changes are dropped before the entry looks for its exit, so the second
    pass reads only as many rows as there are trades.
    """
    rows = df.select(*keys, TS, F.col(price).alias("_price"), F.col("position"))
    if long_only:
        rows = rows.filter(F.col("position") >= 0).withColumn("position", (F.col("position") > 0).cast("int"))
    changes = rolling(rows, [lambda w: {"_before": F.coalesce(F.lag("position").over(w), F.lit(0))}], back=1, keys=keys)
    changes = cut_lineage(changes.filter(F.col("position") != F.col("_before")))
    out = rolling(changes, [lambda w: {"exit_ts": F.lead(TS).over(w), "exit_price": F.lead("_price").over(w)}], back=0, ahead=1, keys=keys)
    closed = out.filter((F.col("position") != 0) & F.col("exit_ts").isNotNull())
    side = F.signum("position")
    return closed.select(*keys, F.col(TS).alias("entry_ts"), "exit_ts", side.cast("int").alias("side"), F.col("_price").alias("entry_price"), "exit_price", (side * (F.col("exit_price") - F.col("_price"))).alias("profit"))


def trade_stats(trades: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Win rate in percent, gains over losses (NULL without a loss) and number of trades."""
    p = F.col("profit")
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, p).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.count_if(p > 0) * 100.0 / F.count(F.lit(1))).alias("win_rate"),
        F.abs(F.try_divide(gain, loss)).alias("profit_loss_ratio"),
        F.sum(p).alias("profit"),
    )


# --- many parameter sets at once ---------------------------------------------------------------
STATE = ["run", "held"]
PARTS = ["run_out", "held_out", "n", "mean", "m2", "grown", "peak", "low", "fall"]


def _moments(r: np.ndarray) -> tuple[float, ...]:
    """Count, mean and squared deviations of returns, and of the logarithm of growth the end, the peak, the lowest point and the deepest fall from a peak."""
    with np.errstate(divide="ignore", invalid="ignore"):
        path = np.cumsum(np.where(r > -1, np.log1p(np.maximum(r, -1)), -np.inf))
        falls = path - np.maximum.accumulate(path)
    mean = r.mean()
    return len(r), mean, ((r - mean) ** 2).sum(), path[-1], path.max(), path.min(), np.nanmin(falls) if not np.isnan(falls).all() else np.nan


def _joined(a: tuple[float, ...] | None, b: tuple[float, ...]) -> tuple[float, ...]:
    """The same of two stretches one after the other. This is associative, so stretches may be cut anywhere."""
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    with np.errstate(invalid="ignore"):
        falls = [a[6], b[6], a[3] + b[5] - a[4]]
        falls = [f for f in falls if not np.isnan(f)]
    return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n, a[3] + b[3], max(a[4], a[3] + b[4]), min(a[5], a[3] + b[5]), min(falls, default=np.nan)


def _runs(signal: np.ndarray, before: int, needed: int) -> tuple[np.ndarray, int]:
    """Which rows confirm a direction, and the signed length of the last run (at most ``needed - 1``), given that of the run before."""
    at = np.flatnonzero(signal)
    hits = np.zeros(len(signal), bool)
    if not len(at):
        return hits, before
    d = signal[at]
    fresh = np.r_[True, d[1:] != d[:-1]]
    length = np.arange(len(d)) - np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0)) + 1
    if before and np.sign(before) == d[0]:
        length[np.cumsum(fresh) == 1] += abs(before)
    hits[at] = length >= needed
    return hits, int(d[-1] * min(length[-1], needed - 1))


def sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    fees: Sequence[float],
    leverages: Sequence[float],
    prediction: str = "prediction",
    price: str = "close",
    keys: Sequence[str] = SERIES,
    periods_per_year: float = 252.0,
    risk_free: float = 0.01,
    memory: int = 5,
    needed: int = 3,
    slippage: float = 0.0005,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Summary per series and parameter set: what ``entry_signals`` to ``summary`` give one set at a time.

    A chunk of a series is read once for all parameter sets. What the rows before it can change is the run of signals
    and the position it starts with, which are few, so a chunk gives one row for each of these and each set; the
    rows of a series follow each other by their states and are joined in order. Nothing is fanned out and nothing stored.
    """
    keys = list(keys)
    states = [(run, held) for run in range(1 - needed, needed) for held in (-1, 0, 1)]
    plain = [*keys, CHUNK]

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf[HALO].all():  # copies of the last rows, for a chunk that does not follow
            return pd.DataFrame(columns=[*plain, "threshold", "fee", "leverage", *STATE, *PARTS])
        pdf = pdf.sort_values(POS)
        first = int((~pdf[HALO]).to_numpy().argmax())
        p = np.r_[0.0, pdf["_p"].fillna(0.0).to_numpy()[:-1]]
        mean = np.zeros(len(p))
        for k in range(memory - 1, -1, -1):
            mean += np.r_[np.zeros(min(k, len(p))), p[: len(p) - k]] if k < len(p) else 0.0
        mean /= memory
        value = pdf["_v"].astype(float).to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.r_[0.0, value[1:] / value[:-1] - 1]
        change = np.where(np.isfinite(change), change, 0.0)[first:]
        out = []
        for threshold in thresholds:
            limit = max(threshold, 0.5)
            signal = (((p > limit) & (mean > 0)).astype(int) - ((p < -limit) & (mean < 0)).astype(int))[first:]
            for run, before in states:
                hits, run_out = _runs(signal, run, needed)
                last = np.maximum.accumulate(np.where(hits, np.arange(len(signal)), -1))
                position = np.where(last >= 0, signal[np.maximum(last, 0)], before)
                held = np.r_[before, position[:-1]]
                gain, turned = held * change, np.abs(position - held)
                for fee in fees:
                    for leverage in leverages:
                        out.append((threshold, fee, leverage, run, before, run_out, int(position[-1]), *_moments(gain * leverage - turned * (fee + slippage))))
        table = pd.DataFrame(out, columns=["threshold", "fee", "leverage", *STATE, *PARTS])
        for k in plain:
            table[k] = pdf[k].iloc[0]
        return table[[*plain, "threshold", "fee", "leverage", *STATE, *PARTS]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    sets = "threshold double, fee double, leverage double"
    rows = positions(df.select(*keys, TS, F.col(prediction).cast("double").alias("_p"), F.col(price).cast("double").alias("_v")), keys).drop(TS)
    parts = chunks(rows, memory + 1, 0, chunk_rows).groupBy(*plain).applyInPandas(
        chunk, f"{kinds}, {CHUNK} bigint, {sets}, run int, held int, run_out int, held_out int, n double, mean double, m2 double, grown double, peak double, low double, fall double"
    )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        # Arrow hands NaN over as missing, which is what a fall without a peak is.
        found = {tuple(r[:3]): r[3:] for r in pdf[[CHUNK, *STATE, *PARTS]].itertuples(index=False, name=None)}
        state, total = (0, 0), None
        for c in sorted(pdf[CHUNK].unique()):
            part = found[(c, *state)]
            state, total = (int(part[0]), int(part[1])), _joined(total, tuple(float(v) for v in part[2:]))
        n, mean, m2, grown, _, _, fall = total
        vol = (m2 / (n - 1)) ** 0.5 * periods_per_year**0.5 if n > 1 else np.nan
        yearly = mean * periods_per_year
        ends = {"bars": int(n), "total_return": np.exp(grown) - 1, "annual_return": yearly, "annual_volatility": vol, "sharpe": (yearly - risk_free) / vol if vol > 0 else 0.0, "max_drawdown": np.exp(fall) - 1}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in [*keys, "threshold", "fee", "leverage"]}, **ends}])

    out = f"{kinds}, {sets}, bars bigint, total_return double, annual_return double, annual_volatility double, sharpe double, max_drawdown double"
    return parts.groupBy(*keys, "threshold", "fee", "leverage").applyInPandas(follow, out)

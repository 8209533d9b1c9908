import numpy as np
import pandas as pd
import pytest
from conftest import bar_frame, ordered, to_bars, walk
from pyspark.sql import functions as F

from tickloom.functions import micro, momentum, price, trend, volatility
from tickloom.functions.core import compute
from tickloom.operators.scan import Scan, ema, scan, wilder
from tickloom.operators.series import epoch_seconds, positions, rolling, running, trailing


def hours(n):
    return F.floor(epoch_seconds("ts") / (3600 * n))


@pytest.mark.parametrize("span", [3, 50, 100000])
def test_positions_and_running_match_one_window(two_series, span):
    df, pdf = two_series
    pdf = pdf.sort_values(["symbol", "ts"])
    out = running(
        positions(df, bucket=hours(span)),
        {"total": ("sum", F.col("volume")), "rows": ("count", F.col("close")), "top": ("max", F.col("high")), "seen": ("last", F.when(F.col("volume") > 5, F.col("close")))},
        bucket=hours(span),
    )
    got = ordered(out, "_pos", "total", "rows", "top", "seen")
    g = pdf.groupby("symbol", sort=True)
    assert (got["_pos"].to_numpy() == g.cumcount().to_numpy()).all()
    assert (got["rows"].to_numpy() == g.cumcount().to_numpy() + 1).all()
    np.testing.assert_allclose(got["total"], g["volume"].cumsum())
    np.testing.assert_allclose(got["top"], g["high"].cummax())
    seen = pdf["close"].where(pdf["volume"] > 5).groupby(pdf["symbol"]).ffill()
    np.testing.assert_allclose(got["seen"].astype(float), seen)


@pytest.mark.parametrize("span", [3, 1000])
def test_running_descending_and_exclusive(two_series, span):
    df, pdf = two_series
    pdf = pdf.sort_values(["symbol", "ts"])
    out = running(df, {"after": ("sum", F.col("volume"))}, bucket=hours(span), exclusive=True, descending=True)
    want = pdf.groupby("symbol")["volume"].transform(lambda s: s[::-1].cumsum()[::-1] - s)
    np.testing.assert_allclose(ordered(out, "after")["after"].fillna(0), want)


@pytest.mark.parametrize("chunk_rows", [21, 64, 100000])
def test_chunked_windows_equal_plain_ones(two_series, chunk_rows):
    df, pdf = two_series
    pdf = pdf.sort_values(["symbol", "ts"])
    out = rolling(df, [lambda w: {"m": F.avg("close").over(trailing(w, 20)), "next": F.lead("close", 3).over(w)}], back=20, ahead=3, chunk_rows=chunk_rows)
    got = ordered(out, "m", "next")
    g = pdf.groupby("symbol")["close"]
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(20, min_periods=1).mean()))
    np.testing.assert_allclose(got["next"].astype(float), g.shift(-3))
    assert out.count() == len(pdf)


def families():
    return [price.price((5,)), volatility.volatility((5,), (20,)), momentum.cci((14,)), micro.price_impact((5, 20)), trend.adx((5,))]


def test_feature_families_do_not_depend_on_chunks(two_series):
    df, _ = two_series
    whole = compute(df, *families()).orderBy("symbol", "ts").toPandas()
    cut = compute(df, *families(), chunk_rows=60).orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(whole, cut[whole.columns], check_exact=False, rtol=1e-9, atol=1e-9)


def test_features_do_not_look_ahead(two_series):
    df, _ = two_series
    end = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    whole = compute(df, *families()).filter(F.col("ts") < end).orderBy("symbol", "ts").toPandas()
    cut = compute(df.filter(F.col("ts") < end), *families()).orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(whole, cut[whole.columns], check_exact=False, rtol=1e-9, atol=1e-9)


def wilder_loop(x, w):
    out, seen, y = [], [], None
    for v in x:
        if np.isnan(v):
            out.append(np.nan if y is None else y)
            continue
        seen.append(v)
        if len(seen) == w:
            y = float(np.mean(seen))
        elif len(seen) > w:
            y = y + (v - y) / w
        out.append(np.nan if y is None else y)
    return out


def ema_loop(x, span, warmup):
    a, y, n, out = 2 / (span + 1), None, 0, []
    for v in x:
        if not np.isnan(v):
            y, n = (v if y is None else (1 - a) * y + a * v), n + 1
        out.append(y if n >= warmup and y is not None else np.nan)
    return out


@pytest.mark.parametrize("rows", [7, 256])
@pytest.mark.parametrize("holes", ["none", "leading", "scattered"])
def test_scans_match_the_recurrence(spark, rows, holes):
    x = walk(900, 5)
    if holes == "leading":
        x[:40] = np.nan
    if holes == "scattered":
        x[np.random.default_rng(0).random(900) < 0.3] = np.nan
    frame = bar_frame(np.where(np.isnan(x), 0, x))
    frame["close"] = x
    df = to_bars(spark, frame, bar_frame(walk(5, 1), "TINY"))
    out = scan(
        df,
        [ema("e", F.col("close"), 12), ema("fast", F.col("close"), 2, 1), wilder("w", F.col("close"), 14), wilder("w50", F.col("close"), 50), Scan("adj", F.col("close"), 0.3, adjusted=True)],
        block=hours(rows),
    )
    got = ordered(out.filter("symbol = 'A'"), "e", "fast", "w", "w50", "adj").astype(float)
    for name, want in {"e": ema_loop(x, 12, 12), "fast": ema_loop(x, 2, 1), "w": wilder_loop(x, 14), "w50": wilder_loop(x, 50)}.items():
        np.testing.assert_allclose(got[name], np.array(want, float), rtol=1e-10, atol=1e-10)
    np.testing.assert_allclose(got["adj"], pd.Series(x).ewm(alpha=0.3, adjust=True, ignore_na=True).mean(), rtol=1e-10)
    tiny = ordered(out.filter("symbol = 'TINY'"), "e", "fast", "w")
    assert tiny["e"].isna().all() and tiny["w"].isna().all() and tiny["fast"].notna().all()


def test_scan_over_many_blocks_and_groups(spark):
    # Three-row blocks give more than 256 of them, so every level of the composition is used.
    x = walk(2000, 9)
    out = scan(to_bars(spark, bar_frame(x)), [ema("e", F.col("close"), 200, 1), wilder("w", F.col("close"), 20)], block=hours(3))
    got = ordered(out, "e", "w").astype(float)
    np.testing.assert_allclose(got["e"], pd.Series(x).ewm(span=200, adjust=False).mean(), rtol=1e-10)
    np.testing.assert_allclose(got["w"], np.array(wilder_loop(x, 20), float), rtol=1e-10)


def test_scan_rejects_a_factor_without_memory(two_series):
    with pytest.raises(ValueError):
        scan(two_series[0], [Scan("x", F.col("close"), 1.0)])


@pytest.mark.parametrize("alpha", [0.5, 0.97, 0.9999])
def test_scan_on_dense_rows(spark, alpha):
    """Many more rows than a bucket has slots, and factors that overflow within 256 rows."""
    x = walk(3000, 3)
    out = scan(to_bars(spark, bar_frame(x, freq="10s")), [Scan("e", F.col("close"), alpha), wilder("w", F.col("close"), 20)], keys=["symbol"])
    got = ordered(out, "e", "w").astype(float)
    np.testing.assert_allclose(got["e"], pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), rtol=1e-9)
    np.testing.assert_allclose(got["w"], np.array(wilder_loop(x, 20), float), rtol=1e-9)


def test_scan_with_equal_times(spark):
    frame = bar_frame(np.full(600, 7.0))
    frame["ts"] = frame["ts"].iloc[0]
    got = scan(to_bars(spark, frame), [Scan("e", F.col("close"), 0.3)], keys=["symbol"]).select("e").distinct().collect()
    assert {round(r.e, 9) for r in got} == {7.0}

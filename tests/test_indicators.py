import numpy as np
import pandas as pd
import pytest
from conftest import bar_frame, ordered, to_bars, walk
from pyspark.sql import functions as F

from tickloom.config import FeatureConfig
from tickloom.functions import core, micro, momentum, price, trend, volatility, volume
from tickloom.functions.core import compute
from tickloom.plans.features import compute_features, indicators


def test_linear_price(spark):
    df = to_bars(spark, bar_frame(np.arange(1.0, 41.0)))
    got = ordered(compute(df, trend.sma((3,)), momentum.rsi((3,))), "sma_3", "rsi_3")
    assert got["sma_3"].isna().sum() == 2
    np.testing.assert_allclose(got["sma_3"][2:], np.arange(2.0, 40.0))
    np.testing.assert_allclose(got["rsi_3"].dropna(), 100.0)


def test_constant_price_gives_nulls_not_errors(spark):
    df = to_bars(spark, bar_frame([5.0] * 60, spread=0.0, volumes=[0.0] * 60))
    out = compute(df, price.price((5,)), volume.volume((5,), (10,)), volume.cumulative(), momentum.rsi((14,)), momentum.stochastic(), momentum.cci((14,)), momentum.mfi((14,)), momentum.ultimate(), momentum.tsi({"tsi": (25, 13)}), micro.volatility_clustering((5,)), micro.price_impact((5,)), micro.range_liquidity((5,)), trend.adx((14,)))
    got = ordered(out, "price_change_pct", "price_volatility", "rel_volume_5", "price_volume_corr_10", "rsi_14", "stoch_k", "cci_14", "mfi_14", "ultimate_osc", "tsi", "volatility_clustering_5", "price_impact_coef_5", "simple_amihud_5", "adx_14", "vwap")
    assert (got["price_change_pct"].dropna() == 0).all()
    for c in ("rel_volume_5", "price_volume_corr_10", "rsi_14", "stoch_k", "cci_14", "mfi_14", "ultimate_osc", "tsi", "volatility_clustering_5", "price_impact_coef_5", "simple_amihud_5", "adx_14", "vwap"):
        assert got[c].isna().all(), c
    numeric = out.select([c for c, t in out.dtypes if t == "double"])
    assert numeric.filter(" OR ".join(f"isnan(`{c}`) OR abs(`{c}`) = double('Infinity')" for c in numeric.columns)).isEmpty()


@pytest.mark.parametrize("rows", [1, 4, 5])
def test_short_series(spark, rows):
    got = ordered(compute(to_bars(spark, bar_frame(walk(rows))), trend.sma((5,)), trend.ema_family((5,))), "sma_5", "ema_5")
    assert got["sma_5"].notna().sum() == max(0, rows - 4)
    assert got["ema_5"].notna().sum() == max(0, rows - 4)


def test_price_scale(spark):
    base = bar_frame(walk(80))
    big = base.copy()
    big[["open", "high", "low", "close"]] *= 10
    fam = lambda: (trend.sma((10,)), momentum.rsi((6,)), momentum.williams((14,)))
    a = ordered(compute(to_bars(spark, base), *fam()), "sma_10", "rsi_6", "williams_14")
    b = ordered(compute(to_bars(spark, big), *fam()), "sma_10", "rsi_6", "williams_14")
    np.testing.assert_allclose(a["sma_10"] * 10, b["sma_10"])
    np.testing.assert_allclose(a["rsi_6"], b["rsi_6"])
    np.testing.assert_allclose(a["williams_14"], b["williams_14"])


def test_rolling_statistics_against_pandas(spark):
    pdf = bar_frame(walk(200, 4), volumes=np.random.default_rng(1).integers(1, 50, 200))
    got = ordered(compute(to_bars(spark, pdf), volume.volume(), volatility.volatility(), micro.volatility_clustering((10,)), micro.price_impact((10,))), "price_volume_corr_20", "returns_volatility_20", "volatility_clustering_10", "arch_effect_10", "price_impact_coef_10").astype(float)
    ret = pdf["close"].pct_change()
    np.testing.assert_allclose(got["price_volume_corr_20"], pdf["close"].rolling(20).corr(pdf["volume"]), rtol=1e-8)
    np.testing.assert_allclose(got["returns_volatility_20"], ret.rolling(20).std(), rtol=1e-8)
    arch = (ret**2).rolling(10).apply(lambda v: v.autocorr(1), raw=False)
    np.testing.assert_allclose(got["arch_effect_10"], arch, rtol=1e-7)
    # The clustering value is withheld until twice the window has passed.
    cluster = ret.abs().rolling(10).apply(lambda v: v.autocorr(1), raw=False)
    cluster[:19] = np.nan
    np.testing.assert_allclose(got["volatility_clustering_10"], cluster, rtol=1e-7)
    slopes = [np.nan] * len(pdf)
    for i in range(11, len(pdf)):
        slopes[i] = np.polyfit(pdf["volume"][i - 10 : i], ret[i - 10 : i], 1)[0]
    np.testing.assert_allclose(got["price_impact_coef_10"], slopes, rtol=1e-6)


def test_dispatcher_names(spark):
    df = to_bars(spark, bar_frame(walk(40)))
    out = indicators(df, ["SMA", "MACD", "ADX"], {"short": [10, 5]})
    assert {"SMA_5", "SMA_10", "MACD", "MACD_signal", "MACD_hist", "ADX_5", "ADX_10"} <= set(out.columns)
    assert not [c for c in out.columns if c.startswith("_")]
    with pytest.raises(ValueError):
        indicators(df, ["NOPE"])


def test_feature_table_columns(spark):
    df = to_bars(spark, bar_frame(walk(60)))
    out = compute_features(df, FeatureConfig(windows={"short": [5, 10]}))
    assert len(out.columns) == len(set(out.columns)) and not [c for c in out.columns if c.startswith("_")]
    assert {"price_gap", "vwap", "atr_14", "ema_200", "adx_pos_20", "tsi_5", "macd_diff", "inferred_flow_10", "signal_rsi_ob_os"} <= set(out.columns)
    assert out.count() == 60
    with pytest.raises(ValueError):
        compute_features(df.drop("volume"))
    with pytest.raises(ValueError):
        compute_features(df, FeatureConfig(groups=("nope",)))


def test_quote_groups_need_quote_columns(spark):
    df = to_bars(spark, bar_frame(walk(30)))
    quoted = df.withColumns({"bid": F.col("low"), "ask": F.col("high"), "bid_volume": F.lit(2.0), "ask_volume": F.lit(1.0), "trade_direction": F.lit(1.0)})
    config = FeatureConfig(groups=("market_microstructure",), windows={"short": [5]})
    assert {"spread", "amihud_ratio_5", "order_flow_5"} <= set(compute_features(quoted, config).columns)
    plain = compute_features(df, config).columns
    assert "spread" not in plain and "range_liquidity_5" in plain and "inferred_flow_5" in plain


def test_long_windows_equal_sliding_frames(spark, monkeypatch):
    pdf = bar_frame(walk(420, 6), volumes=np.random.default_rng(3).integers(0, 50, 420))
    pdf.loc[100:260, ["open", "high", "low", "close"]] = 90.0
    df = to_bars(spark, pdf, bar_frame(walk(120, 8), "B"))
    quoted = df.withColumns({"bid": F.col("low") - 0.5, "ask": F.col("high"), "bid_volume": F.col("volume") + 2, "ask_volume": F.lit(1.0), "trade_direction": F.signum(F.col("close") - F.col("open"))})
    sizes = (5, 100, 130)
    fam = lambda: (trend.sma(sizes), micro.order_flow(sizes), micro.inferred_flow(sizes), micro.quote_liquidity(sizes), micro.range_liquidity(sizes), micro.volatility_clustering(sizes), micro.price_impact(sizes))
    fast = compute(quoted, *fam(), chunk_rows=150).orderBy("symbol", "ts").toPandas()
    monkeypatch.setattr(core, "LONG_ROWS", 10**9)
    slow = compute(quoted, *fam()).orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(slow, fast[slow.columns], check_exact=False, rtol=1e-8, atol=1e-12)
    assert slow["volatility_clustering_100"].notna().any() and slow["price_impact_coef_130"].notna().any()


@pytest.mark.parametrize("rows", [99, 100])
def test_one_rule_for_windows_that_hardly_vary(spark, rows):
    """Noise of rounding size is no variance, whether a window is short or long; a real small variance is one."""
    n = 3 * rows
    noise = np.where(np.arange(n) % 2, 1.0, 1.0 + 1e-15)
    real = 1.0 + 1e-6 * np.random.default_rng(4).normal(size=n)
    for volumes, some in ((1e9 * noise, False), (np.full(n, 7.0), False), (1e9 * real, True)):
        df = to_bars(spark, bar_frame(walk(n, 3), volumes=volumes))
        got = compute(df, micro.price_impact((rows,))).toPandas()[f"price_impact_coef_{rows}"]
        assert got.notna().any() == some
    steady = to_bars(spark, bar_frame(100 * 1.001 ** np.arange(n)))
    found = compute(steady, micro.volatility_clustering((rows,))).toPandas()
    assert found[[f"volatility_clustering_{rows}", f"arch_effect_{rows}"]].isna().all().all()

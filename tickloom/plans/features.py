"""Indicator dispatch by name and the whole feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tickloom.config import FeatureConfig, all_windows
from tickloom.functions import micro, momentum, price, signals, trend, volatility, volume
from tickloom.functions.core import Family, compute
from tickloom.operators.labels import lags, targets
from tickloom.session import cut_lineage

INDICATORS = {
    "SMA": lambda w: [trend.sma(w, "SMA", relative=False)],
    "EMA": lambda w: [trend.ema_family(w, "EMA", relative=False)],
    "WMA": lambda w: [trend.wma(w)],
    "MACD": lambda w: [momentum.macd(names=("MACD", "MACD_signal", "MACD_hist"))],
    "RSI": lambda w: [momentum.rsi(w, "RSI")],
    "STOCH": lambda w: [momentum.stochastic(5, 3, ("STOCH_K", "STOCH_D"))],
    "BBANDS": lambda w: [volatility.bbands(w)],
    "ATR": lambda w: [volatility.atr(w, "ATR")],
    "ADX": lambda w: [trend.adx(w, "ADX", directions=False)],
    "CCI": lambda w: [momentum.cci(w, "CCI")],
    "ROC": lambda w: [momentum.roc(w, "ROC", momentum=())],
    "OBV": lambda w: [volume.cumulative(("OBV",))],
    "MFI": lambda w: [momentum.mfi(w, "MFI")],
}

NEEDED = ("open", "high", "low", "close", "volume")


def indicators(bars: DataFrame, names: Sequence[str] | None = None, windows: dict[str, list[int]] | Sequence[int] | None = None) -> DataFrame:
    """Bars plus the named indicators over every window; unknown names raise."""
    names = list(names or INDICATORS)
    unknown = [n for n in names if n not in INDICATORS]
    if unknown:
        raise ValueError(f"unknown indicators {unknown}; expected some of {list(INDICATORS)}")
    if windows is None:
        windows = {"short": [5, 10, 20], "medium": [50, 100, 200], "long": [500]}
    sizes = tuple(all_windows(windows) if isinstance(windows, dict) else sorted(set(windows)))
    families = [f for n in names for f in INDICATORS[n](sizes)]
    return compute(bars, *families, cut=cut_lineage)


def group_families(bars: DataFrame, groups: Sequence[str], windows: tuple[int, ...]) -> list[Family]:
    """Families of each group; quote columns decide which microstructure families apply."""
    quoted = {"bid", "ask"} <= set(bars.columns)
    sided = quoted and {"bid_volume", "ask_volume"} <= set(bars.columns)
    directed = "trade_direction" in bars.columns
    table = {
        "price_based": lambda: [price.price()],
        "volume_based": lambda: [volume.volume(), volume.cumulative(("vwap", "nvi", "pvt"))],
        "volatility": lambda: [volatility.volatility(), volatility.atr()],
        "trend": lambda: [trend.sma(), trend.ema_family(), trend.ma_ratios(), trend.adx(), trend.ichimoku()],
        "momentum": lambda: [
            momentum.price_change(), momentum.rsi(), momentum.stochastic(), momentum.roc(), momentum.cci(), momentum.williams(),
            momentum.mfi(), momentum.ultimate(), momentum.tsi(), momentum.macd(),
        ],
        "market_microstructure": lambda: [
            *([micro.quote()] if sided else [micro.quote_prices()] if quoted else []),
            micro.quote_liquidity(windows) if sided else micro.range_liquidity(windows),
            micro.order_flow(windows) if directed else micro.inferred_flow(windows),
            micro.volatility_clustering(windows),
            micro.price_impact(windows),
        ],
        "signals": lambda: [signals.sma_cross(), momentum.macd(), signals.macd_sign(), momentum.rsi((14,)), signals.rsi_zone()],
    }
    unknown = [g for g in groups if g not in table]
    if unknown:
        raise ValueError(f"unknown feature groups {unknown}; expected some of {list(table)}")
    return [f for g in groups for f in table[g]()]


def compute_features(bars: DataFrame, config: FeatureConfig | None = None) -> DataFrame:
    """Bars plus every column of the configured groups."""
    config = config or FeatureConfig()
    missing = [c for c in NEEDED if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack {missing}")
    families = group_families(bars, config.groups, tuple(all_windows(config.windows)))
    return compute(bars, *families, cut=cut_lineage)


def training_table(bars: DataFrame, horizons: Sequence[int], config: FeatureConfig | None = None, lagged: Sequence[str] = ("close",)) -> DataFrame:
    """Features, lags and forward targets on one key."""
    config = config or FeatureConfig()
    out = compute_features(bars, config)
    return targets(lags(out, lagged, config.lags), horizons)

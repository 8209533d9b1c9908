"""Vocabulary and defaults shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

KEYS = ("symbol", "timeframe")
TS = "ts"

# Bar sizes in rising order and their length in seconds.
TIMEFRAME_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "1w": 604800,
}

# Window sizes per term, label horizons in minutes and lag steps.
WINDOWS = {"short": [5, 10, 20], "medium": [50, 100, 200], "long": [500, 1000]}
HORIZON_MINUTES = (60, 240, 1440, 4320, 10080, 20160)
LAGS = (1, 2, 3, 5, 10)

# The groups of features.
FEATURE_GROUPS = (
    "price_based",
    "volume_based",
    "volatility",
    "trend",
    "momentum",
    "market_microstructure",
    "signals",
)

# Columns taken from each bar size by the cross-timeframe table.
CROSS_TIMEFRAME_FEATURES = {
    "1h": ["vwap", "rsi_14", "macd", "bollinger_width_20", "atr_14", "price_change_20", "pvt", "OBV"],
    "4h": ["sma_50", "ema_50", "price_rel_sma_50", "price_rel_ema_50", "adx_14", "cci_20", "tsi"],
    "1d": ["sma_200", "ema_200", "price_rel_sma_200", "ichimoku_a", "ichimoku_b", "momentum_20", "stoch_k", "stoch_d"],
}


def all_windows(windows: dict[str, list[int]] | None = None) -> list[int]:
    """Flatten the per-term windows into one sorted list."""
    return sorted({w for group in (windows or WINDOWS).values() for w in group})


def timeframe_seconds(timeframe: str) -> int:
    try:
        return TIMEFRAME_SECONDS[timeframe]
    except KeyError:
        raise ValueError(f"unknown timeframe {timeframe!r}; expected one of {list(TIMEFRAME_SECONDS)}") from None


def horizon_rows(timeframe: str, minutes: tuple[int, ...] = HORIZON_MINUTES) -> list[int]:
    """Horizons in whole bars of ``timeframe``; those shorter than one bar are left out."""
    step = timeframe_seconds(timeframe)
    return sorted({m * 60 // step for m in minutes if m * 60 >= step})


@dataclass(frozen=True)
class FeatureConfig:
    """What ``plans.features.compute_features`` builds."""

    groups: tuple[str, ...] = FEATURE_GROUPS
    windows: dict[str, list[int]] = field(default_factory=lambda: dict(WINDOWS))
    lags: tuple[int, ...] = LAGS
    horizon_minutes: tuple[int, ...] = HORIZON_MINUTES

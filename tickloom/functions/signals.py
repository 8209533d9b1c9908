"""Discrete signals; a missing input gives 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.core import Family, roll


def sma_cross(fast: int = 5, slow: int = 20) -> Family:
    """1 on the bar where the fast mean rises above the slow one."""
    c = F.col("close")

    def first(w):
        return {"_fast": roll(F.avg, c, w, fast), "_slow": roll(F.avg, c, w, slow)}

    def second(w):
        above = F.col("_fast") > F.col("_slow")
        was_not = F.lag("_fast").over(w) <= F.lag("_slow").over(w)
        return {f"signal_sma_cross_{fast}_{slow}": F.when(above & was_not, 1).otherwise(0)}

    return Family(levels=(first, second), back=slow + 1, temp=("_fast", "_slow"))


def macd_sign(column: str = "macd_diff") -> Family:
    return Family(final=lambda: {"signal_macd_hist_sign": F.coalesce(F.signum(F.col(column)), F.lit(0.0)).cast("int")})


def rsi_zone(column: str = "rsi_14", high: float = 70, low: float = 30) -> Family:
    x = F.col(column)
    return Family(final=lambda: {"signal_rsi_ob_os": F.when(x > high, 1).when(x < low, -1).otherwise(0)})

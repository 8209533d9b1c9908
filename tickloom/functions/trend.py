"""Moving averages, directional movement and mid-range lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import core
from tickloom.functions.core import Family, Long, div, roll
from tickloom.functions.volatility import linear_wma, true_range
from tickloom.operators.scan import ema, wilder


def sma(windows: tuple[int, ...] = (5, 10, 20, 50, 100, 200), prefix: str = "sma", relative: bool = True) -> Family:
    c = F.col("close")

    def first(w):
        return {f"{prefix}_{n}": roll(F.avg, c, w, n) for n in windows if n < core.LONG_ROWS}

    return Family(
        levels=(first,),
        back=max(windows),
        long=tuple(Long(f"{prefix}_{n}", "mean", "close", n) for n in windows if n >= core.LONG_ROWS),
        final=lambda: {f"price_rel_{prefix}_{n}": div(c, F.col(f"{prefix}_{n}")) for n in windows} if relative else {},
    )


def ema_family(windows: tuple[int, ...] = (5, 10, 20, 50, 100, 200), prefix: str = "ema", relative: bool = True) -> Family:
    c = F.col("close")
    return Family(
        scans=(tuple(ema(f"{prefix}_{n}", c, n) for n in windows),),
        final=lambda: {f"price_rel_{prefix}_{n}": div(c, F.col(f"{prefix}_{n}")) for n in windows} if relative else {},
    )


def wma(windows: tuple[int, ...] = (5, 10, 20), prefix: str = "WMA") -> Family:
    return Family(levels=(lambda w: {f"{prefix}_{n}": linear_wma(F.col("close"), w, n) for n in windows},), back=max(windows))


def ma_ratios() -> Family:
    """Ratios of neighbouring averages; needs the 5, 20 and 50 row averages of both kinds."""
    pairs = ((5, 20), (20, 50))
    return Family(
        final=lambda: {f"{k}_{a}_{b}_ratio": div(F.col(f"{k}_{a}"), F.col(f"{k}_{b}")) for k in ("sma", "ema") for a, b in pairs}
    )


def adx(windows: tuple[int, ...] = (14, 20), prefix: str = "adx", directions: bool = True) -> Family:
    def first(w):
        up = F.col("high") - F.lag("high").over(w)
        down = F.lag("low").over(w) - F.col("low")
        return {
            "_dm_pos": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "_dm_neg": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
            "_dm_tr": F.when(up.isNotNull(), true_range(w)),
        }

    smooth = tuple(
        wilder(f"_{part}_{n}", F.col(f"_{part}"), n) for n in windows for part in ("dm_pos", "dm_neg", "dm_tr")
    )
    pos, neg = (f"{prefix}_pos", f"{prefix}_neg") if directions else (f"_{prefix}_pos", f"_{prefix}_neg")

    def between():
        out = {}
        for n in windows:
            tr = F.col(f"_dm_tr_{n}")
            p, m = 100 * div(F.col(f"_dm_pos_{n}"), tr), 100 * div(F.col(f"_dm_neg_{n}"), tr)
            out[f"{pos}_{n}"], out[f"{neg}_{n}"] = p, m
            out[f"_dx_{n}"] = 100 * div(F.abs(p - m), p + m)
        return out

    temp = [f"_{part}_{n}" for n in windows for part in ("dm_pos", "dm_neg", "dm_tr", "dx")] + ["_dm_pos", "_dm_neg", "_dm_tr"]
    if not directions:
        temp += [f"{d}_{n}" for n in windows for d in (pos, neg)]
    return Family(
        levels=(first,),
        back=1,
        scans=(smooth, tuple(wilder(f"{prefix}_{n}", F.col(f"_dx_{n}"), n) for n in windows)),
        between=between,
        temp=tuple(temp),
    )


def ichimoku() -> Family:
    h, l = F.col("high"), F.col("low")

    def middle(w, n):
        return (roll(F.max, h, w, n) + roll(F.min, l, w, n)) / 2

    def first(w):
        conv, base = middle(w, 9), middle(w, 26)
        return {"ichimoku_conv": conv, "ichimoku_base": base, "ichimoku_a": (conv + base) / 2, "ichimoku_b": middle(w, 52)}

    return Family(levels=(first,), back=52)

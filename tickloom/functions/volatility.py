"""Ranges, bands and dispersion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.functions.core import Family, div, roll
from tickloom.operators.scan import wilder


def true_range(w):
    pc = F.lag("close").over(w)
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def returns(w):
    return div(F.col("close"), F.lag("close").over(w)) - 1


def volatility(windows: tuple[int, ...] = (5, 10, 20, 50), band_windows: tuple[int, ...] = (20, 50)) -> Family:
    c, o, h, l = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    typical = (h + l + c) / 3

    def first(w):
        out = {
            "true_range": true_range(w),
            "_ret": returns(w),
            "garman_klass_vol": 0.5 * F.pow(F.ln(div(h, l)), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(div(c, o)), 2),
        }
        for n in band_windows:
            out[f"bollinger_width_{n}"] = div(4 * roll(F.stddev_pop, c, w, n), roll(F.avg, c, w, n)) * 100
        upper = roll(F.avg, (4 * h - 2 * l + c) / 3, w, 20)
        lower = roll(F.avg, (-2 * h + 4 * l + c) / 3, w, 20)
        out["keltner_width"] = div(upper - lower, roll(F.avg, typical, w, 20))
        return out

    def second(w):
        out = {}
        r = F.col("_ret")
        for n in windows:
            out[f"returns_volatility_{n}"] = roll(F.stddev_samp, r, w, n)
            out[f"returns_range_{n}"] = roll(F.max, r, w, n) - roll(F.min, r, w, n)
            out[f"garman_klass_vol_{n}"] = roll(F.avg, F.col("garman_klass_vol"), w, n)
        return out

    return Family(levels=(first, second), back=max(20, *windows, *band_windows) + 1, temp=("_ret",))


def atr(windows: tuple[int, ...] = (5, 10, 14, 20, 50), prefix: str = "atr") -> Family:
    """Wilder mean of the true range, seeded with its first plain mean."""
    return Family(
        levels=(lambda w: {"_tr": true_range(w)},),
        back=1,
        scans=(tuple(wilder(f"{prefix}_{n}", F.col("_tr"), n) for n in windows),),
        temp=("_tr",),
    )


def bbands(windows: tuple[int, ...] = (20, 50)) -> Family:
    c = F.col("close")

    def first(w):
        out = {}
        for n in windows:
            mid, dev = roll(F.avg, c, w, n), roll(F.stddev_pop, c, w, n)
            out[f"BBANDS_upper_{n}"] = mid + 2 * dev
            out[f"BBANDS_middle_{n}"] = mid
            out[f"BBANDS_lower_{n}"] = mid - 2 * dev
            out[f"BBANDS_width_{n}"] = div(4 * dev, mid) * 100
        return out

    return Family(levels=(first,), back=max(windows))


def simple_variants(windows: tuple[int, ...] = (14, 20)) -> Family:
    """Plain-mean forms: sample-deviation bands, RSI and ATR over simple means, linear WMA."""
    c = F.col("close")

    def first(w):
        change = c - F.lag(c).over(w)
        out = {"_tr": true_range(w), "_up": F.greatest(change, F.lit(0.0)), "_dn": F.greatest(-change, F.lit(0.0))}
        out["_up"] = F.when(change.isNotNull(), out["_up"])
        out["_dn"] = F.when(change.isNotNull(), out["_dn"])
        for n in windows:
            mid, dev = roll(F.avg, c, w, n), roll(F.stddev_samp, c, w, n)
            out[f"bbands_simple_upper_{n}"] = mid + 2 * dev
            out[f"bbands_simple_lower_{n}"] = mid - 2 * dev
            out[f"bbands_simple_width_{n}"] = div(2 * dev, mid)
            out[f"wma_{n}"] = linear_wma(c, w, n)
        return out

    def second(w):
        out = {}
        for n in windows:
            up, dn = roll(F.avg, F.col("_up"), w, n), roll(F.avg, F.col("_dn"), w, n)
            out[f"rsi_sma_{n}"] = div(100 * up, up + dn)
            out[f"atr_sma_{n}"] = roll(F.avg, F.col("_tr"), w, n)
        return out

    return Family(levels=(first, second), back=max(windows) + 1, temp=("_tr", "_up", "_dn"))


def linear_wma(value, w, n: int):
    """Mean weighted 1..n from oldest to newest; the frame holds at most n values."""
    frame = w.rowsBetween(-(n - 1), 0)
    weighted = F.zip_with(F.collect_list(value).over(frame), F.sequence(F.lit(1), F.lit(n)), lambda x, k: x * k)
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.count(value).over(frame) == n, total / (n * (n + 1) / 2))

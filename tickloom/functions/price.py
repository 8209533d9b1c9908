"""Price-derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.core import Family, div, roll

def price(windows: tuple[int, ...] = (5, 10, 20, 50)) -> Family:
    c, o, h, l = F.col("close"), F.col("open"), F.col("high"), F.col("low")

    def first(w):
        out = {
            "price_change_pct": div(c, F.lag(c).over(w)) - 1,
            "price_gap": div(h - l, l),
            "open_close_diff": div(c - o, o),
            "high_low_diff": div(h - l, l),
        }
        for n in windows:
            out[f"price_rel_high_{n}"] = div(c, roll(F.max, h, w, n))
            out[f"price_rel_low_{n}"] = div(c, roll(F.min, l, w, n))
        return out

    def second(w):
        return {"price_volatility": roll(F.stddev_samp, F.col("price_change_pct"), w, 20)}

    return Family(levels=(first, second), back=max(21, *windows))

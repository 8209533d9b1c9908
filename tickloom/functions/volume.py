"""Volume-derived columns: windowed ratios and cumulative indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.core import Family, correlation, div, filled, roll
from tickloom.operators.series import trailing


def volume(windows: tuple[int, ...] = (5, 10, 20, 50), corr_windows: tuple[int, ...] = (10, 20)) -> Family:
    c, v = F.col("close"), F.col("volume")

    def first(w):
        out = {"volume_change_pct": div(v, F.lag(v).over(w)) - 1}
        for n in windows:
            out[f"rel_volume_{n}"] = div(v, roll(F.avg, v, w, n))
        for n in corr_windows:
            ready = filled(c, w, n) & filled(v, w, n)
            out[f"price_volume_corr_{n}"] = F.when(ready, correlation(c, v, trailing(w, n)))
        out["volume_oscillator"] = div(roll(F.avg, v, w, 5), roll(F.avg, v, w, 20))
        return out

    return Family(levels=(first,), back=max(20, *windows, *corr_windows))


def _previous(w):
    return {"_pc": F.lag("close").over(w), "_pv": F.lag("volume").over(w)}


def cumulative(names: tuple[str, ...] = ("vwap", "nvi", "pvt", "OBV")) -> Family:
    """Indices summed from the start of the series."""
    c, v, h, l = F.col("close"), F.col("volume"), F.col("high"), F.col("low")
    pc, pv = F.col("_pc"), F.col("_pv")
    typical = (h + l + c) / 3
    change = div(c, pc) - 1
    all_totals = {
        "vwap": {"_tpv_sum": ("sum", typical * v), "_v_sum": ("sum", v)},
        "nvi": {"_nvi_log": ("sum", F.when(v < pv, F.ln(div(c, pc))).otherwise(0.0))},
        "pvt": {"pvt": ("sum", F.coalesce(change * v, F.lit(0.0)))},
        "OBV": {"OBV": ("sum", F.when(c < pc, -v).otherwise(v))},
    }
    totals = {k: t for n in names for k, t in all_totals[n].items()}

    def final():
        out = {}
        if "vwap" in names:
            out["vwap"] = div(F.col("_tpv_sum"), F.col("_v_sum"))
        if "nvi" in names:
            out["nvi"] = 1000 * F.exp(F.col("_nvi_log"))
        return out

    needs_lag = any(n != "vwap" for n in names)
    return Family(
        levels=(_previous,) if needs_lag else (),
        back=1 if needs_lag else 0,
        totals=totals,
        final=final,
        temp=("_pc", "_pv", "_tpv_sum", "_v_sum", "_nvi_log"),
    )

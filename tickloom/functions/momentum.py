"""Rates of change and oscillators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.core import Family, div, filled, roll
from tickloom.operators.scan import ema, wilder
from tickloom.operators.series import trailing


def price_change(steps: tuple[int, ...] = (1, 5, 10, 20, 50, 100)) -> Family:
    c = F.col("close")
    return Family(levels=(lambda w: {f"price_change_{n}": div(c, F.lag(c, n).over(w)) - 1 for n in steps},), back=max(steps))


def roc(windows: tuple[int, ...] = (10, 20, 50), prefix: str = "roc", momentum: tuple[int, ...] = (10, 20)) -> Family:
    """Percent rate of change; ``momentum_*`` is 100 times the percentage."""
    c = F.col("close")

    def first(w):
        rate = lambda n: (div(c, F.lag(c, n).over(w)) - 1) * 100
        return {**{f"{prefix}_{n}": rate(n) for n in windows}, **{f"momentum_{n}": rate(n) * 100 for n in momentum}}

    return Family(levels=(first,), back=max(*windows, *momentum) if momentum else max(windows))


def rsi(windows: tuple[int, ...] = (2, 6, 14, 20), prefix: str = "rsi") -> Family:
    def first(w):
        change = F.col("close") - F.lag("close").over(w)
        return {
            "_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
            "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        }

    sides = tuple(wilder(f"_{side}_{n}", F.col(f"_{side}"), n) for n in windows for side in ("gain", "loss"))

    def final():
        return {f"{prefix}_{n}": div(100 * F.col(f"_gain_{n}"), F.col(f"_gain_{n}") + F.col(f"_loss_{n}")) for n in windows}

    temp = ("_gain", "_loss", *[f"_{s}_{n}" for n in windows for s in ("gain", "loss")])
    return Family(levels=(first,), back=1, scans=(sides,), final=final, temp=temp)


def _range_position(w, n: int):
    high, low = roll(F.max, F.col("high"), w, n), roll(F.min, F.col("low"), w, n)
    return div(F.col("close") - low, high - low)


def stochastic(window: int = 14, smooth: int = 3, names: tuple[str, str] = ("stoch_k", "stoch_d")) -> Family:
    k, d = names
    return Family(
        levels=(lambda w: {k: 100 * _range_position(w, window)}, lambda w: {d: roll(F.avg, F.col(k), w, smooth)}),
        back=window + smooth,
    )


def williams(windows: tuple[int, ...] = (14, 20)) -> Family:
    def first(w):
        out = {}
        for n in windows:
            high, low = roll(F.max, F.col("high"), w, n), roll(F.min, F.col("low"), w, n)
            out[f"williams_{n}"] = -100 * div(high - F.col("close"), high - low)
        return out

    return Family(levels=(first,), back=max(windows))


def cci(windows: tuple[int, ...] = (14, 20), prefix: str = "cci") -> Family:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3

    def first(w):
        out = {"_tp": typical}
        for n in windows:
            out[f"_tps_{n}"] = F.when(filled(typical, w, n), F.collect_list(typical).over(trailing(w, n)))
            out[f"_tpm_{n}"] = roll(F.avg, typical, w, n)
        return out

    def final():
        out = {}
        for n in windows:
            mean = F.col(f"_tpm_{n}")
            spread = F.aggregate(F.transform(f"_tps_{n}", lambda x: F.abs(x - mean)), F.lit(0.0), lambda acc, x: acc + x) / n
            out[f"{prefix}_{n}"] = div(F.col("_tp") - mean, 0.015 * spread)
        return out

    # The lists hold at most the window length and are consumed before anything is shuffled again.
    return Family(
        levels=(first, lambda w: final()),
        back=max(windows),
        temp=("_tp", *[f"_{p}_{n}" for n in windows for p in ("tps", "tpm")]),
    )


def mfi(windows: tuple[int, ...] = (14, 20), prefix: str = "mfi") -> Family:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3

    def first(w):
        flow = typical * F.col("volume")
        before = F.lag(typical).over(w)
        return {
            "_mf": flow,
            "_mf_pos": F.when(typical > before, flow).otherwise(0.0),
            "_mf_neg": F.when(typical < before, flow).otherwise(0.0),
        }

    def second(w):
        out = {}
        for n in windows:
            pos, neg = F.sum("_mf_pos").over(trailing(w, n)), F.sum("_mf_neg").over(trailing(w, n))
            out[f"{prefix}_{n}"] = F.when(filled(F.col("_mf"), w, n), div(100 * pos, pos + neg))
        return out

    return Family(levels=(first, second), back=max(windows) + 1, temp=("_mf", "_mf_pos", "_mf_neg"))


def ultimate() -> Family:
    c, h, l = F.col("close"), F.col("high"), F.col("low")

    def first(w):
        pc = F.lag(c).over(w)
        floor = F.least(l, pc)
        return {"_bp": c - floor, "_uo_tr": F.greatest(h, pc) - floor}

    def second(w):
        def part(n):
            return div(F.sum("_bp").over(trailing(w, n)), F.sum("_uo_tr").over(trailing(w, n)))

        return {"ultimate_osc": F.when(filled(F.col("_bp"), w, 28), 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7)}

    return Family(levels=(first, second), back=29, temp=("_bp", "_uo_tr"))


def tsi(pairs: dict[str, tuple[int, int]] | None = None) -> Family:
    """Doubly smoothed change over doubly smoothed absolute change."""
    pairs = pairs or {"tsi": (25, 13), "tsi_5": (5, 2), "tsi_10": (10, 5), "tsi_20": (20, 10)}

    def first(w):
        change = F.col("close") - F.lag("close").over(w)
        return {"_chg": change, "_chg_abs": F.abs(change)}

    once = tuple(ema(f"_{n}_{s}1", F.col(f"_chg{s}"), r, 1) for n, (r, _) in pairs.items() for s in ("", "_abs"))
    twice = tuple(ema(f"_{n}_{s}2", F.col(f"_{n}_{s}1"), q, 1) for n, (_, q) in pairs.items() for s in ("", "_abs"))
    return Family(
        levels=(first,),
        back=1,
        scans=(once, twice),
        final=lambda: {n: 100 * div(F.col(f"_{n}_2"), F.col(f"_{n}__abs2")) for n in pairs},
        temp=("_chg", "_chg_abs", *[s.name for s in (*once, *twice)]),
    )


def macd(fast: int = 12, slow: int = 26, signal: int = 9, names: tuple[str, str, str] = ("macd", "macd_signal", "macd_diff")) -> Family:
    line, smooth, diff = names
    c = F.col("close")
    quick, calm = f"_macd_ema_{fast}", f"_macd_ema_{slow}"
    return Family(
        scans=((ema(quick, c, fast), ema(calm, c, slow)), (ema(smooth, F.col(line), signal),)),
        between=lambda: {line: F.col(quick) - F.col(calm)},
        final=lambda: {diff: F.col(line) - F.col(smooth)},
        temp=(quick, calm),
    )

"""Lags, targets and sequence windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import KEYS, LAGS
from tickloom.operators.series import rolling


def lags(df: DataFrame, cols: Sequence[str], steps: Sequence[int] = LAGS, keys: Sequence[str] = KEYS) -> DataFrame:
    return rolling(df, [lambda w: {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in cols for n in steps}], back=max(steps), keys=keys)


def _joined(parts: Sequence[Sequence[Column]]) -> tuple[Column, Column, Column]:
    """Count, mean and squared deviations of stretches together; a stretch past the end is NULL and counts nothing."""
    zero = F.lit(0.0)
    n, mean, m2 = ([F.coalesce(p[i], zero) for p in parts] for i in range(3))
    rows = reduce(lambda x, y: x + y, n)
    middle = F.coalesce(F.try_divide(reduce(lambda x, y: x + y, [a * b for a, b in zip(n, mean, strict=True)]), rows), zero)
    return rows, middle, reduce(lambda x, y: x + y, [q + a * (b - middle) * (b - middle) for a, b, q in zip(n, mean, m2, strict=True)])


def targets(df: DataFrame, horizons: Sequence[int], mode: str = "forward", periods_per_year: float = 252.0, volatility: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Percent change, direction and volatility over each horizon, in rows.

    ``forward`` looks ahead, which is what a label should do; ``trailing`` measures the change up
    to the row. Volatility covers the h-1 returns after the row, scaled to a year. The moments of 1, 2, 4, ... rows ahead
    are each two of the level before, and a horizon joins the levels that add up to it, so a row costs the logarithm of the horizon.
    """
    if mode not in ("forward", "trailing"):
        raise ValueError(f"mode must be 'forward' or 'trailing', got {mode!r}")
    c, far = F.col("close"), max(horizons)
    powers = (far - 1).bit_length() if volatility and far > 2 else 0
    used = {h: [k for k in range(powers) if (h - 1) >> k & 1] for h in horizons}

    def first(w):
        out = {}
        for h in horizons:
            change = F.try_divide(F.lead(c, h).over(w), c) if mode == "forward" else F.try_divide(c, F.lag(c, h).over(w))
            out[f"target_pct_{h}"] = (change - 1) * 100
        if powers:
            ret = F.try_divide(c, F.lag(c).over(w)) - 1
            out |= {"_n0": ret.isNotNull().cast("double"), "_a0": F.coalesce(ret, F.lit(0.0)), "_q0": F.lit(0.0)}
        return out

    def ahead(w, k: int, rows: int) -> list[Column]:
        return [F.lead(f"_{c}{k}", rows).over(w) for c in "naq"]

    def doubled(k: int):
        return lambda w: {f"_{c}{k}_2": v for c, v in zip("naq", ahead(w, k - 1, 1 << (k - 1)))}

    def met(k: int):
        both = lambda: _joined([[F.col(f"_{c}{k - 1}") for c in "naq"], [F.col(f"_{c}{k}_2") for c in "naq"]])
        return lambda w: {f"_{c}{k}": v for c, v in zip("naq", both())}

    def parts(w):
        """The stretches that make up the rows after this one, by horizon."""
        out = {}
        for h in horizons if powers else ():
            offset = 1
            for k in used[h]:
                out |= {f"_{c}{k}_of_{h}": v for c, v in zip("naq", ahead(w, k, offset))}
                offset += 1 << k
            out[f"_r{h}"] = F.lead(c, h).over(w).isNotNull()
        return out

    def last(w):
        out = {}
        for h in horizons:
            out[f"target_direction_{h}"] = F.when(F.col(f"target_pct_{h}") > 0, 1).otherwise(0)
            if volatility and h > 2:
                n, _, m2 = _joined([[F.col(f"_{c}{k}_of_{h}") for c in "naq"] for k in used[h]])
                spread = F.sqrt(F.when(n > 1, m2 / (n - 1)))
                out[f"target_volatility_{h}"] = F.when(F.col(f"_r{h}"), spread * periods_per_year**0.5)
            elif volatility:
                out[f"target_volatility_{h}"] = F.lit(None).cast("double")
        return out

    levels = [first, *(level for k in range(1, powers) for level in (doubled(k), met(k))), parts, last]
    drop = [f"_{c}{k}" for c in "naq" for k in range(powers)] + [f"_{c}{k}_2" for c in "naq" for k in range(1, powers)]
    drop += [f"_{c}{k}_of_{h}" for c in "naq" for h in horizons for k in used[h]] + ([f"_r{h}" for h in horizons] if powers else [])
    return rolling(df, levels, back=far if mode == "trailing" else 1, ahead=far if mode == "forward" or volatility else 0, keys=keys, drop=drop)


def recent_changes(df: DataFrame, steps: dict[str, int] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Changes over 1, 4 and 24 hourly rows, used when no label is given."""
    steps = steps or {"price_change_1h": 1, "price_change_4h": 4, "price_change_1d": 24}
    c = F.col("close")
    return rolling(df, [lambda w: {k: F.try_divide(c, F.lag(c, n).over(w)) - 1 for k, n in steps.items()}], back=max(steps.values()), keys=keys)


def sequences(df: DataFrame, cols: Sequence[str], length: int, label: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``length`` rows before each row as an array of structs; incomplete ones are left out.

    The array is bounded by ``length``. ``label`` is the row's own value, so it follows its inputs.
    """
    packed = F.struct(*[F.col(c).cast("double").alias(c) for c in cols])
    out = rolling(df, [lambda w: {"sequence": F.collect_list(packed).over(w.rowsBetween(-length, -1))}], back=length, keys=keys)
    out = out.filter(F.size("sequence") == length)
    return out.select(*[k for k in (*keys, "ts")], "sequence", *([F.col(label).alias("label")] if label else []))

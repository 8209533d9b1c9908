"""Joins on time: exact, as-of and multi-timeframe alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import KEYS, TS, timeframe_seconds
from tickloom.operators.clean import fill_both_ways
from tickloom.operators.resample import bar_grid
from tickloom.operators.series import running


def inner(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*KEYS, TS)) -> DataFrame:
    """Rows present on both sides, e.g. features with targets or prices with predictions."""
    return left.join(right, list(keys), "inner")


def missing(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` that ``present`` does not hold."""
    return wanted.join(present.select(*on), list(on), "left_anti")


def asof(base: DataFrame, sides: Mapping[str, DataFrame], by: Sequence[str] = ("symbol",), available: bool = True) -> DataFrame:
    """Attach to each base row the latest row of every side at or before its time.

    ``sides`` maps a timeframe to its table; its columns are prefixed with it. With ``available``
    a coarse bar is visible only from its close on; without it, from its open. All sides travel in
    one tagged union, so any number of timeframes costs one ordered pass.
    """
    by = list(by)
    packed, columns = [], {}
    for tf, side in sides.items():
        columns[tf] = [c for c in side.columns if c not in (*by, TS, "timeframe")]
        shift = F.make_dt_interval(secs=F.lit(timeframe_seconds(tf))) if available else F.make_dt_interval(secs=F.lit(0))
        packed.append(side.select(*by, (F.col(TS) + shift).alias(TS), F.lit(0).alias("_tag"), F.struct(*columns[tf]).alias(f"_{tf}")))
    union = base.select(*by, TS, F.lit(1).alias("_tag"), F.struct(*[c for c in base.columns if c not in (*by, TS)]).alias("_base"))
    for p in packed:
        union = union.unionByName(p, allowMissingColumns=True)
    carried = running(union, {f"_l_{tf}": ("last", F.col(f"_{tf}")) for tf in sides}, by, TS, ties=["_tag"])
    out = carried.filter(F.col("_tag") == 1)
    picked = [F.col(f"_l_{tf}.{c}").alias(f"{tf}_{c}") for tf in sides for c in columns[tf]]
    return out.select(*[F.col(c) if c in (*by, TS) else F.col(f"_base.{c}").alias(c) for c in base.columns], *picked)


def upsample(coarse: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarse rows repeated on a finer grid between their first and last time."""
    grid = bar_grid(coarse, timeframe, keys)
    values = coarse.drop("timeframe") if "timeframe" not in keys else coarse
    out = asof(grid, {"1m": values}, by=keys, available=False)
    return out.select(*keys, TS, *[F.col(f"1m_{c}").alias(c) for c in values.columns if c not in (*keys, TS)])


def integrate(
    tables: Mapping[str, DataFrame],
    base: str,
    columns: Mapping[str, Sequence[str]],
    available: bool = True,
    fill: bool = False,
) -> DataFrame:
    """One table on the base timeframe with prefixed columns of every timeframe.

    A timeframe finer than the base must be aggregated first. ``fill`` also fills leading rows
    from later values and is therefore off by default.
    """
    if base not in tables:
        raise ValueError(f"no table for base timeframe {base!r}")
    finer = [tf for tf in tables if timeframe_seconds(tf) < timeframe_seconds(base)]
    if finer:
        raise ValueError(f"resample {finer} to {base} or coarser first")
    own = tables[base].select("symbol", TS, *[F.col(c).alias(f"{base}_{c}") for c in columns.get(base, [])])
    sides = {tf: t.select("symbol", TS, *columns[tf]) for tf, t in sorted(tables.items(), key=lambda kv: timeframe_seconds(kv[0])) if tf != base}
    out = asof(own, sides, available=available)
    return fill_both_ways(out, [c for c in out.columns if c not in ("symbol", TS)], ["symbol"]) if fill else out


def diagnose(left: DataFrame, right: DataFrame, target: str | None = None, keys: Sequence[str] = ("symbol", TS)) -> DataFrame:
    """One row: sizes, time ranges, overlap and whether either side lies wholly before the other."""
    value = F.col(target) if target else F.lit(None).cast("double")
    l = left.select(*keys, F.col(TS).alias("_lt"), F.lit(1).alias("_l"))
    r = right.select(*keys, F.col(TS).alias("_rt"), F.lit(1).alias("_r"), value.alias("_y"))
    both = l.join(r, list(keys), "full_outer")
    out = both.agg(
        F.count("_l").alias("left_rows"),
        F.count("_r").alias("right_rows"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common_rows"),
        F.count_if(F.col("_l").isNotNull() & F.col("_y").isNotNull()).alias("common_valid"),
        F.min("_lt").alias("left_min"), F.max("_lt").alias("left_max"), F.min("_rt").alias("right_min"), F.max("_rt").alias("right_max"),
    )
    return out.withColumns({"right_before_left": F.col("right_max") < F.col("left_min"), "right_after_left": F.col("right_min") > F.col("left_max")})

"""Ticks to bars, bars to coarser bars, gap rows and generic bucket aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.config import KEYS, TS, timeframe_seconds
from tickloom.operators.series import epoch_seconds


ORIGIN = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def from_epoch(seconds: str, unit: str = "SECOND") -> Column:
    """Zone-free timestamp from a whole number of seconds (or of ``unit``) since 1970-01-01."""
    return F.expr(f"{ORIGIN} + ({seconds}) * INTERVAL '1' {unit}")


def slot(ts: str, seconds: int) -> Column:
    """Number of the epoch-aligned interval of ``seconds`` that holds ``ts``."""
    return F.floor(epoch_seconds(ts) / seconds)


def floor_ts(ts: str, seconds: int) -> Column:
    """Start of the epoch-aligned interval of ``seconds`` that holds ``ts``."""
    return F.expr(f"{ORIGIN} + floor(CAST(CAST({ts} - {ORIGIN} AS INTERVAL SECOND) AS BIGINT) / {seconds}) * INTERVAL '{seconds}' SECOND")


def ticks_to_bars(ticks: DataFrame, timeframe: str, ties: Sequence[str] = ()) -> DataFrame:
    """Bars from ``symbol, ts, price, size``; ``ties`` order ticks of equal time.

    Every aggregate combines before the shuffle, so a symbol with a third of all ticks costs each
    task one partial row per bar.
    """
    seconds = timeframe_seconds(timeframe)
    at = F.struct(TS, *ties) if ties else F.col(TS)
    return (
        ticks.select("symbol", "price", "size", slot(TS, seconds).alias("_slot"), at.alias("at"))
        .groupBy("symbol", "_slot")
        .agg(
            F.min_by("price", "at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "at").alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), from_epoch(f"_slot * {seconds}").alias(TS), "open", "high", "low", "close", "volume")
    )


def resample(bars: DataFrame, timeframe: str, fill_gaps: bool = False) -> DataFrame:
    """Coarser OHLCV bars. Null prices are skipped and a null volume counts as zero."""
    seconds = timeframe_seconds(timeframe)
    out = (
        bars.select("symbol", slot(TS, seconds).alias("_slot"), TS, "open", "high", "low", "close", "volume")
        .groupBy("symbol", "_slot")
        .agg(
            F.min_by("open", F.when(F.col("open").isNotNull(), F.col(TS))).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.when(F.col("close").isNotNull(), F.col(TS))).alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), from_epoch(f"_slot * {seconds}").alias(TS), "open", "high", "low", "close", "volume")
    )
    return with_gap_rows(out, timeframe) if fill_gaps else out


def bar_grid(bars: DataFrame, timeframe: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every bar time between each series' first and last bar.

    The grid is expanded in two steps, day ranges first, so that no single row explodes into a
    whole series.
    """
    seconds = timeframe_seconds(timeframe)
    block = max(86400, seconds) if 86400 % seconds == 0 or seconds % 86400 == 0 else seconds
    start, stop = F.col("_lo"), F.col("_hi")
    ends = bars.groupBy(*keys).agg(F.min(epoch_seconds(TS)).alias("_lo"), F.max(epoch_seconds(TS)).alias("_hi"))
    first_block = F.floor(start / block) * block
    blocks = ends.select(*keys, "_lo", "_hi", F.explode(F.sequence(first_block, stop, F.lit(block).cast("long"))).alias("_b"))
    slots = blocks.repartition(*keys, "_b").select(
        *keys, "_lo", "_hi", F.explode(F.sequence(F.col("_b"), F.col("_b") + F.lit(block - seconds).cast("long"), F.lit(seconds).cast("long"))).alias("_s")
    )
    return slots.filter((F.col("_s") >= start) & (F.col("_s") <= stop)).select(*keys, from_epoch("_s").alias(TS))


def with_gap_rows(bars: DataFrame, timeframe: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per grid slot; slots without a bar get NULL prices and zero volume."""
    grid = bar_grid(bars, timeframe, keys)
    out = grid.join(bars, [*keys, TS], "left")
    return out.withColumn("volume", F.coalesce("volume", F.lit(0.0))).select(*bars.columns)


AGGREGATES = {
    "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(TS))),
    "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(TS))),
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "mean": F.avg,
    "count": F.count,
    "std": F.stddev_samp,
}


def resample_with(df: DataFrame, timeframe: str, how: Mapping[str, str] | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bucket aggregates from a ``{column: function name}`` map.

    Without a map numeric columns are averaged and any other column keeps its last value.
    """
    if how is None:
        skip = {*keys, TS, "timeframe"}
        how = {f.name: "mean" if isinstance(f.dataType, T.NumericType) else "last" for f in df.schema.fields if f.name not in skip}
    unknown = {f for f in how.values() if f not in AGGREGATES}
    if unknown:
        raise ValueError(f"unknown aggregate {sorted(unknown)}; expected one of {sorted(AGGREGATES)}")
    bar_ts = floor_ts(TS, timeframe_seconds(timeframe))
    return (
        df.withColumn("bar_ts", bar_ts)
        .groupBy(*keys, "bar_ts")
        .agg(*[AGGREGATES[f](c).alias(c) for c, f in how.items()])
        .withColumnRenamed("bar_ts", TS)
    )

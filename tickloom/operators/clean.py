"""Deduplication, date filters, fills and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.config import KEYS, TS
from tickloom.operators.series import positions, running, time_bucket

PRICES = ("open", "high", "low", "close")

# The timestamp layouts accepted when normalising text times.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ssXX", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd HH:mm:ss")


def dedupe(df: DataFrame, order: Sequence[str], keep: str = "first", keys: Sequence[str] = (*KEYS, TS)) -> DataFrame:
    """One row per key: the first or last by ``order``, which must be a total order per key.

    An aggregate rather than a ranked window: copies combine before the shuffle, so a key that
    holds a large share of the rows sends one row per task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', got {keep!r}")
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def append_sources(sources: Iterable[DataFrame], keep: str = "first", keys: Sequence[str] = (*KEYS, TS), within: Sequence[str] = ()) -> DataFrame:
    """Union of several sources, one row per key; earlier sources come first in the keep order.

    ``within`` orders rows of one source; without it the whole row does, so the choice is stable.
    """
    parts = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in keys and c != "_source"]
    return dedupe(out, ["_source", *(within or rest)], keep, keys).drop("_source")


def between(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = TS) -> DataFrame:
    """Rows with ``start <= ts <= end``; the bounds reach the parquet scan."""
    kind = df.schema[ts].dataType
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(kind))
    return df


def fill_bars(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Carry prices forward; a missing volume is zero."""
    specs = {f"_f_{c}": ("last", F.col(c)) for c in PRICES}
    out = running(bars, specs, keys)
    filled = {c: F.col(f"_f_{c}") for c in PRICES}
    return out.withColumns({**filled, "volume": F.coalesce("volume", F.lit(0.0))}).select(*bars.columns)


def fill_forward(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    out = running(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys)
    return out.withColumns({c: F.col(f"_f_{c}") for c in cols}).select(*df.columns)


def fill_both_ways(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Forward fill, then fill what precedes the first value from it.

    After the forward fill only leading rows are empty, so the backward fill is each series' first
    value: one small aggregate instead of a second ordered pass.
    """
    first = df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(TS))).alias(f"_b_{c}") for c in cols])
    out = fill_forward(df, cols, keys).join(first, list(keys))
    return out.withColumns({c: F.coalesce(c, f"_b_{c}") for c in cols}).select(*df.columns)


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, list(cols))


def model_input(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Both-way fill, then zero, and no infinities: what a fit accepts."""
    finite = df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in cols})
    return fill_both_ways(finite, cols, keys).fillna(0.0, list(cols))


def repair_target(df: DataFrame, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Missing labels become the mean of the series' valid ones, else zero. Off unless called."""
    means = df.groupBy(*keys).agg(F.avg(target).alias("_mean"))
    return df.join(means, list(keys)).withColumn(target, F.coalesce(target, "_mean", F.lit(0.0))).drop("_mean").select(*df.columns)


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols is not None else None)


def target_gate(df: DataFrame, targets: Sequence[str], limit: float = 0.7) -> DataFrame:
    """Per target: rows, missing share and whether it may be trained on."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).isNull().alias("missing")) for t in targets])).alias("e")).select("e.*")
    share = F.avg(F.col("missing").cast("double"))
    return long.groupBy("target").agg(F.count("*").alias("rows"), share.alias("missing_share"), ((share <= limit) & (share < 1)).alias("usable"))


def parse_time(text: str | Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """First layout that reads ``text`` gives the zone-free timestamp; else NULL."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def minute_index(df: DataFrame, start: str, order: str = TS, step_seconds: int = 60, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace times by ``start + i * step`` in the order of ``order``."""
    origin = F.lit(start).cast("timestamp_ntz")
    out = positions(df, keys, order, name="_i")
    return out.withColumn(TS, origin + F.make_dt_interval(secs=F.col("_i") * step_seconds)).select(*df.columns)


def project(df: DataFrame, names: str | Sequence[str], sets: dict[str, Sequence[str]] | None = None, keys: Sequence[str] = (*KEYS, TS), strict: bool = True) -> DataFrame:
    """Keys plus a named feature set, a comma list or a list of columns."""
    if isinstance(names, str):
        names = list(sets[names]) if sets and names in sets else [n.strip() for n in names.split(",") if n.strip()]
    missing = [n for n in names if n not in df.columns]
    if missing and strict:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[k for k in keys if k in df.columns], *[n for n in names if n in df.columns and n not in keys])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def numeric_only(df: DataFrame, keys: Sequence[str] = (*KEYS, TS)) -> DataFrame:
    return df.select(*[k for k in keys if k in df.columns], *numeric_columns(df, keys))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str] = (*KEYS, TS)) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def latest(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = TS, bucket: Column | None = None) -> DataFrame:
    """The last ``n`` rows of each series.

    Rows are counted by time bucket and the counts summed from the end; only buckets with fewer than ``n`` rows after
    them are read, so the ranking sees ``n`` rows and one bucket of a series however long it is. ``bucket`` must be monotone in ``order``.
    """
    placed = df.withColumn("_bucket", time_bucket(df, order) if bucket is None else bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    after = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.withColumn("_after", F.coalesce(after, F.lit(0))).filter(F.col("_after") < n).select(*keys, "_bucket")
    few = placed.join(needed, [*keys, "_bucket"], "left_semi").drop("_bucket")
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return few.withColumn("recency", final).filter(F.col("recency") <= n)

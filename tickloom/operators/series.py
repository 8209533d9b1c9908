"""Ordered series without one-task-per-series windows.

A series is every row with the same key, ordered by time. One series may hold a large share of all
rows, so no window here partitions by the key alone over row data. Two building blocks replace it:

* ``running``: cumulative values. Rows are bucketed by time, each bucket is reduced to one row, the
  small bucket table is prefix-combined, and the prefix is added to a window inside the bucket.
* ``rolling``: bounded windows. Rows get an exact position, are cut into equal chunks by position,
  and every chunk receives copies of its neighbours' edge rows, so a window inside the chunk sees
  what a window over the whole series would.

The number of buckets of a series is bounded by the calendar (time span / bucket length) and the
rows of a bucket by the bar size, so neither grows with the number of series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.config import KEYS, TIMEFRAME_SECONDS, TS

POS = "_pos"
CHUNK = "_chunk"
BUCKET = "_bucket"
HALO = "_halo"
PHASE = "_phase"
STRIDE = 25
BUCKET_ROWS = 16384
CHUNK_ROWS = 16384

Level = Callable[[WindowSpec], Mapping[str, Column]]


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970-01-01 of a zone-free timestamp, independent of the session zone."""
    return F.expr(f"CAST(CAST({ts} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS BIGINT)")


def bar_seconds(df: DataFrame, default: int = 60) -> Column:
    """Length of each row's bar, from its ``timeframe`` column when there is one."""
    if "timeframe" not in df.columns:
        return F.lit(default)
    cases = " ".join(f"WHEN '{name}' THEN {seconds}" for name, seconds in TIMEFRAME_SECONDS.items())
    return F.expr(f"CASE timeframe {cases} ELSE {default} END")


def time_bucket(df: DataFrame, order: str = TS, rows: int = BUCKET_ROWS) -> Column:
    """Bucket number that holds at most ``rows`` grid slots of the row's own bar size."""
    return F.floor(epoch_seconds(order) / (bar_seconds(df) * rows))


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](value)


def _over(kind: str, value: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind]
    return fn(value).over(w)


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        zero = F.lit(0) if kind == "count" else F.lit(0.0)
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(F.coalesce(before, zero) + here)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


def running(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column]],
    keys: Sequence[str] = KEYS,
    order: str = TS,
    ties: Sequence[str] = (),
    bucket: Column | None = None,
    exclusive: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add cumulative columns. ``specs`` maps a name to (sum|count|max|min|last, value).

    ``ties`` are further order columns. ``exclusive`` leaves the current row out; ``descending``
    accumulates from the end. ``bucket`` must be monotone in ``order``.
    """
    keys = list(keys)
    by = [order, *ties]
    src = df.withColumns(
        {BUCKET: time_bucket(df, order) if bucket is None else bucket, **{f"_v_{n}": v for n, (_, v) in specs.items()}}
    )
    rank = F.struct(*by) if ties else F.col(order)
    if descending:
        totals = src.groupBy(*keys, BUCKET).agg(
            *[
                (F.min_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), rank)) if k == "last" else _total(k, F.col(f"_v_{n}"), rank)).alias(f"_t_{n}")
                for n, (k, _) in specs.items()
            ]
        )
        outer = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc())
        local = Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(c).desc() for c in by])
    else:
        totals = src.groupBy(*keys, BUCKET).agg(*[_total(k, F.col(f"_v_{n}"), rank).alias(f"_t_{n}") for n, (k, _) in specs.items()])
        outer = Window.partitionBy(*keys).orderBy(BUCKET)
        local = Window.partitionBy(*keys, BUCKET).orderBy(*by)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    inside = local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    # Counts of buckets add up; every other kind combines with itself.
    carry = totals.select(*keys, BUCKET, *[_over("sum" if k == "count" else k, F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n, (k, _) in specs.items()])
    rows = src.withColumns({f"_l_{n}": _over(k, F.col(f"_v_{n}"), inside) for n, (k, _) in specs.items()})
    joined = rows.join(carry, [*keys, BUCKET], "left")
    temp = [f"_{p}_{n}" for n in specs for p in ("v", "l", "c")]
    return joined.withColumns({n: _combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in specs.items()}).drop(*temp, BUCKET)


def positions(df: DataFrame, keys: Sequence[str] = KEYS, order: str = TS, name: str = POS, ties: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Add the exact 0-based position of each row in its series."""
    out = running(df, {name: ("count", F.lit(1))}, keys, order, ties, bucket)
    return out.withColumn(name, F.col(name) - 1)


def chunk_window(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(POS)


def chunks(src: DataFrame, back: int, ahead: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Deal rows with positions to equal chunks; copies of the neighbours' edge rows are marked."""
    size = max(chunk_rows, back, ahead, 1)
    own = F.expr(f"{POS} div {size}")
    copies = [own]
    if back:
        copies.append(F.when(F.col(POS) % size >= size - back, own + 1))
    if ahead:
        copies.append(F.when(F.col(POS) % size < ahead, own - 1))
    if len(copies) == 1:
        return src.withColumn(CHUNK, own).withColumn(HALO, F.lit(False))
    src = src.withColumn(CHUNK, F.explode(F.array_compact(F.array(*copies))))
    return src.withColumn(HALO, F.col(CHUNK) != own)


def rolling(
    df: DataFrame,
    levels: Iterable[Level],
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    order: str = TS,
    drop: Sequence[str] = (),
    keep_pos: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    ties: Sequence[str] = (),
    bucket: Column | None = None,
    strided: Level | None = None,
) -> DataFrame:
    """Add window columns level by level.

    Each level maps a window spec to new columns and may use the columns of earlier levels.
    ``back`` and ``ahead`` are the total number of rows a result can depend on, over all levels.
    ``strided`` runs last, on windows that step over ``STRIDE`` rows at a time.
    """
    keys = list(keys)
    had_pos = POS in df.columns
    src = chunks(df if had_pos else positions(df, keys, order, ties=ties, bucket=bucket), back, ahead, chunk_rows)
    w = chunk_window(keys)
    for level in levels:
        columns = dict(level(w))
        if columns:
            src = src.withColumns(columns)
    if strided is not None:
        src = src.withColumn(PHASE, F.expr(f"{POS} % {STRIDE}"))
        src = src.withColumns(dict(strided(Window.partitionBy(*keys, CHUNK, PHASE).orderBy(POS)))).drop(PHASE)
    out = src.filter(~F.col(HALO)).drop(HALO, CHUNK, *drop)
    return out if keep_pos or had_pos else out.drop(POS)


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    """The last ``rows`` rows including the current one."""
    return w.rowsBetween(-(rows - 1), Window.currentRow)

"""Exponential recurrences of any length: y[t] = (1-alpha) * y[t-1] + alpha * x[t].

The recurrence is affine, so it composes. Within a block of rows it has the closed form
``a^k * sum(alpha * x[i] * a^-k[i])``; a block is then summarised by the number of values it
holds and its closing value. Blocks are cut by row number inside a bucket of time, however many rows
a bucket holds, at 256 rows or fewer where a^-rows would come near the largest number. Summaries are composed
block -> group of 256 buckets -> series, on ever smaller tables, and each block's carry joins back to its rows:

    y = local + a^k * carry

Everything is built-in Spark expressions; no series is ever held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import KEYS, TS
from tickloom.operators.series import time_bucket

BLOCK_ROWS = 256

#: Largest exponent of e that a^-rows may reach, well below the 709 at which doubles end.
LARGEST_EXPONENT = 600.0


@dataclass(frozen=True)
class Scan:
    """One recurrence.

    ``seed='first'`` starts at the first value; ``seed='mean'`` starts, at the ``warmup``-th value,
    with the mean of the first ``warmup`` values. Output is NULL until ``warmup`` values were seen.
    Rows without a value keep the previous result.
    """

    name: str
    value: Column
    alpha: float
    seed: str = "first"
    warmup: int = 1
    adjusted: bool = False


def ema(name: str, value: Column, span: int, warmup: int | None = None) -> Scan:
    return Scan(name, value, 2.0 / (span + 1), "first", span if warmup is None else warmup)


def wilder(name: str, value: Column, window: int) -> Scan:
    return Scan(name, value, 1.0 / window, "mean", window)


def _fold(items: str, start: str) -> str:
    """SQL: the value carried into each item, followed by the value after the last one."""
    return f"aggregate({items}, array({start}), (acc, s) -> concat(acc, array(element_at(acc, -1) * pow(a, s.n) + s.b)))"


def _counts(items: str) -> str:
    return f"aggregate({items}, array(0L), (acc, s) -> concat(acc, array(element_at(acc, -1) + s.n)))"


def _first(items: str) -> str:
    return f"try_element_at(filter(transform({items}, s -> s.f), v -> v IS NOT NULL), 1)"


def _heads(items: str) -> str:
    return f"slice(flatten(transform({items}, s -> s.h)), 1, w)"


def _seed(scans: Sequence[Scan]) -> str:
    """SQL: the value in force before the first row, so that the recurrence starts as asked."""
    cases = []
    for i, s in enumerate(scans):
        if s.adjusted:
            start = "0D"
        elif s.seed == "first":
            start = "f"
        else:
            weighted = "zip_with(h, sequence(1, greatest(size(h), 1)), (x, k) -> x * (pow(a, -w) - pow(a, -k)))"
            start = f"CASE WHEN size(h) >= w THEN aggregate({weighted}, 0D, (acc, v) -> acc + coalesce(v, 0D)) / w END"
        cases.append(f"WHEN {i} THEN {start}")
    return f"coalesce(CASE sid {' '.join(cases)} END, 0D)"


def block_rows(scans: Sequence[Scan]) -> int:
    """Rows of a block for which the closed form of all scans stays finite."""
    return max(1, min(BLOCK_ROWS, *(int(LARGEST_EXPONENT / -math.log(1.0 - s.alpha)) for s in scans)))


def scan(df: DataFrame, scans: Sequence[Scan], keys: Sequence[str] = KEYS, order: str = TS, block: Column | None = None) -> DataFrame:
    """Add one column per recurrence, all in one pass over the rows.

    ``block`` numbers buckets of rows, rising with ``order``; the default is time. Rows of one series with
    equal ``order`` are taken in any order, one after the other.
    """
    for s in scans:
        if not 0.0 < s.alpha < 1.0:
            raise ValueError(f"{s.name}: alpha must lie strictly between 0 and 1, got {s.alpha}")
    keys = list(keys)
    ids = range(len(scans))
    a = [f"{1.0 - s.alpha!r}D" for s in scans]
    over = f"OVER (PARTITION BY {', '.join([*keys, '_block', '_sub'])} ORDER BY _rn ROWS UNBOUNDED PRECEDING)"

    rows = df.withColumns(
        {"_block": time_bucket(df, order, BLOCK_ROWS) if block is None else block, **{f"_x{i}": scans[i].value.cast("double") for i in ids}}
    )
    rows = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join([*keys, '_block'])} ORDER BY {order}) AS _rn")
    rows = rows.selectExpr("*", f"(_rn - 1) div {block_rows(scans)} AS _sub")
    rows = rows.selectExpr("*", *[f"count(_x{i}) {over} AS _k{i}" for i in ids])
    rows = rows.selectExpr(
        "*", *[f"coalesce(sum(_x{i} * pow({a[i]}, -_k{i})) {over} * pow({a[i]}, _k{i}) * {scans[i].alpha!r}D, 0D) AS _z{i}" for i in ids]
    )

    # One summary per block and scan; only mean-seeded scans need their first values kept.
    def summary(i: int) -> str:
        head = "CAST(array() AS array<double>)"
        if scans[i].seed == "mean":
            head = f"transform(array_sort(collect_list(CASE WHEN _x{i} IS NOT NULL AND _k{i} <= {scans[i].warmup} THEN struct(_k{i} AS k, _x{i} AS x) END)), e -> e.x)"
        return (
            f"struct({i} AS sid, {a[i]} AS a, {scans[i].warmup} AS w, max(_k{i}) AS n, max_by(_z{i}, _rn) AS b, "
            f"min_by(_x{i}, CASE WHEN _x{i} IS NOT NULL THEN _rn END) AS f, {head} AS h)"
        )

    blocks = rows.groupBy(*keys, "_block", "_sub").agg(F.expr(f"array({', '.join(summary(i) for i in ids)}) AS s")).selectExpr(*keys, "_block", "_sub", "inline(s)")
    groups = (
        blocks.groupBy(*keys, "sid", "a", "w", F.expr(f"_block div {BLOCK_ROWS} AS _group"))
        .agg(F.expr("array_sort(collect_list(struct(_block AS i, _sub AS j, n, b, f, h))) AS bs"))
        .selectExpr("*", f"struct(_group AS i, aggregate(bs, 0L, (acc, s) -> acc + s.n) AS n, element_at({_fold('bs', '0D')}, -1) AS b, {_first('bs')} AS f, {_heads('bs')} AS h) AS t")
    )
    series = (
        groups.groupBy(*keys, "sid", "a", "w")
        .agg(F.expr("array_sort(collect_list(t)) AS gs"))
        .selectExpr("*", f"{_first('gs')} AS f", f"{_heads('gs')} AS h")
        .selectExpr(*keys, "sid", "transform(gs, s -> s.i) AS _group", f"{_counts('gs')} AS n0", f"{_fold('gs', _seed(scans))} AS c0")
        .selectExpr(*keys, "sid", "inline(arrays_zip(_group, n0, c0))")
        .filter("_group IS NOT NULL")
    )
    carries = (
        groups.select(*keys, "_group", "sid", "a", "bs")
        .join(series, [*keys, "_group", "sid"])
        .selectExpr(*keys, "sid", "n0", "transform(bs, s -> s.i) AS _block", "transform(bs, s -> s.j) AS _sub", f"{_counts('bs')} AS n", f"{_fold('bs', 'c0')} AS c")
        .selectExpr(*keys, "sid", "n0", "inline(arrays_zip(_block, _sub, n, c))")
        .filter("_block IS NOT NULL")
        .groupBy(*keys, "_block", "_sub")
        .agg(F.expr("map_from_entries(collect_list(struct(sid, struct(n0 + n AS n, c)))) AS _carry"))
    )
    results = []
    for i, s in enumerate(scans):
        seen = f"(_carry[{i}].n + _k{i})"
        value = f"(_z{i} + pow({a[i]}, _k{i}) * _carry[{i}].c)"
        if s.adjusted:
            value = f"{value} / (1D - pow({a[i]}, {seen}))"
        results.append(f"CASE WHEN {seen} >= {max(s.warmup, 1)} THEN {value} END AS {s.name}")
    joined = rows.join(carries, [*keys, "_block", "_sub"])
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], *results)

"""Global order statistics: cumulative counts by value, exact quantiles, dense and average ranks.

Equal values are first combined into one counted row (before the shuffle), so a value held by a
third of all rows costs nothing extra. Distinct values are then spread over range slots of at most ``SLOT_VALUES``
of them. Splitters are approximate quantiles of the distinct values, as many as their number asks for; slots that come
out too large are split again. Splitters only balance the work and never change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import running
from tickloom.session import cut_lineage

#: Distinct values that one task sorts, and most slots that one round makes of a group or slot.
SLOT_VALUES, SPLIT = 1 << 20, 256
STEP = 16


def _split(placed: DataFrame, by: Sequence[str], value: str, parts: int, few: bool) -> DataFrame:
    """Refine ``_slot`` by ``parts`` ranges of the distinct values of each of ``by``."""
    cuts = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    edges = placed.groupBy(*by).agg(F.expr(f"approx_percentile({value}, array({cuts}), {max(1000, 8 * parts)})").alias("_edges"))
    # Every STEP-th edge narrows the search, so a lookup compares with few of them.
    edges = edges.withColumn("_coarse", F.expr(f"filter(_edges, (e, i) -> i % {STEP} = {STEP - 1})"))
    if by:
        found = placed.join(F.broadcast(edges) if few else edges, list(by))
    else:
        found = placed.withColumn("_s", edges.select(F.struct("_edges", "_coarse")).scalar()).select("*", "_s.*").drop("_s")
    found = found.withColumn("_major", F.expr(f"size(filter(_coarse, e -> e < {value})) * {STEP}"))
    minor = f"size(filter(slice(_edges, _major + 1, {STEP}), e -> e < {value}))"
    return found.withColumn("_slot", F.expr(f"_slot * {SPLIT} + CAST(_major + {minor} AS BIGINT)")).drop("_edges", "_coarse", "_major")


def slotted(counts: DataFrame, groups: Sequence[str], value: str, parts: int, slot_values: int = SLOT_VALUES) -> DataFrame:
    """Counted distinct values with a ``_slot`` that ascends with the value and holds at most ``slot_values`` of a group.

    ``parts`` is how many slots the largest group wants.
    """
    placed = counts.withColumn("_slot", F.lit(0).cast("bigint"))
    if parts <= 1:
        return placed
    placed = _split(placed, groups, value, min(parts, SPLIT), groups == ["feature"])
    while True:
        placed = cut_lineage(placed)
        sizes = placed.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > slot_values)
        largest = sizes.agg(F.max("_size")).first()[0]
        if largest is None:
            return placed
        # Slots that are too large are few: each holds more than slot_values values.
        marked = placed.join(sizes, [*groups, "_slot"], "left")
        large = _split(marked.filter("_size IS NOT NULL").drop("_size"), [*groups, "_slot"], value, min(SPLIT, 2 * -(-largest // slot_values)), False)
        placed = marked.filter("_size IS NULL").drop("_size").withColumn("_slot", F.col("_slot") * SPLIT).unionByName(large)


def value_counts(df: DataFrame, groups: Sequence[str], value: str, edges: int | None = None, extra: Sequence[Column] = (), slot_values: int = SLOT_VALUES) -> DataFrame:
    """Per group and distinct value: ``_cnt`` rows, ``_cum`` rows up to and including it, ``_dense``
    rank from 0 and ``_n`` rows of the group; ``extra`` are further aggregates per value.

    ``edges`` asks for a number of slots; without it the number follows the distinct values. Tables of one row a group are broadcast only
    when groups are column names, whose number the schema bounds; otherwise Spark chooses the join from measured sizes.
    """
    groups = list(groups)
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_cnt"), *extra))
    totals = counts.groupBy(*groups).agg(F.sum("_cnt").alias("_n"), F.count(F.lit(1)).alias("_d"))
    largest = totals.agg(F.max("_d")).first()[0] or 0
    placed = slotted(counts, groups, value, -(-largest // slot_values) if edges is None else edges, slot_values)
    out = running(placed, {"_cum": ("sum", F.col("_cnt")), "_dense": ("count", F.lit(1))}, groups, value, bucket=F.col("_slot"))
    totals = totals.drop("_d")
    if groups:
        out = out.join(F.broadcast(totals) if groups == ["feature"] else totals, groups)
    else:
        out = out.withColumn("_n", totals.scalar())
    return out.withColumn("_dense", F.col("_dense") - 1).drop("_slot")


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], edges: int | None = None) -> DataFrame:
    """Exact quantiles per group with linear interpolation, one column per entry of ``probs``."""
    counts = value_counts(df, groups, value, edges)
    picked = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(p)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_cum") - F.col("_cnt") <= index) & (index < F.col("_cum"))
            picked.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
    out = counts.groupBy(*groups).agg(F.max("_n").alias("_n"), *picked)
    exact = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        exact.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*groups, *exact)


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column): the column's name and its value as DOUBLE."""
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*keep, F.explode(entries).alias("_e")).select(*keep, f"_e.{name}", f"_e.{value}")


def average_ranks(counts: DataFrame) -> DataFrame:
    """1-based mean rank of each value of ``value_counts``."""
    return counts.withColumn("_rank", F.col("_cum") - (F.col("_cnt") - 1) / 2.0)

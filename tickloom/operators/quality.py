"""Data quality and distribution reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import KEYS, TS
from tickloom.operators.ranks import long_form, quantiles
from tickloom.operators.series import epoch_seconds, rolling


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) for every column."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])).alias("e")).select("e.*")


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that repeat the values of an earlier row; keys and times are left to the caller."""
    per_value = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def unsorted_times(df: DataFrame, arrival: str, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Per series: rows whose time lies before that of the row that arrived just before."""
    bucket = F.floor(F.col(arrival) / 65536)
    out = rolling(df.select(*keys, ts, arrival), [lambda w: {"_before": F.lag(ts).over(w)}], back=1, keys=keys, order=arrival, bucket=bucket)
    return out.groupBy(*keys).agg(F.count_if(F.col(ts) < F.col("_before")).alias("out_of_order"))


def irregular_intervals(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Per series: the most common step in seconds (smallest on ties) and how many steps differ."""
    out = rolling(df.select(*keys, ts), [lambda w: {"_prev": F.lag(ts).over(w)}], back=1, keys=keys, order=ts)
    steps = out.filter(F.col("_prev").isNotNull()).withColumn("_step", epoch_seconds(ts) - epoch_seconds("_prev"))
    counted = steps.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    common = F.max_by("_step", F.struct(F.col("_n"), -F.col("_step")))
    report = counted.groupBy(*keys).agg(common.alias("common_step"), F.sum("_n").alias("steps"), (F.sum("_n") - F.max("_n")).alias("irregular"))
    return report.withColumn("irregular_percent", F.try_divide(F.col("irregular") * 100.0, F.col("steps")))


def outliers(df: DataFrame, cols: Sequence[str], width: float = 1.5) -> DataFrame:
    """Per column: bounds ``[q1 - width*iqr, q3 + width*iqr]``, rows outside and their share."""
    long = long_form(df, cols)
    bounds = quantiles(long, ["feature"], "value", {"q1": 0.25, "q3": 0.75})
    bounds = bounds.select(
        "feature", (F.col("q1") - width * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + width * (F.col("q3") - F.col("q1"))).alias("upper")
    )
    # One row per column name, so the bound table is as small as the schema.
    judged = long.join(F.broadcast(bounds), "feature")
    outside = F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    return judged.groupBy("feature").agg(
        F.first("lower").alias("lower"), F.first("upper").alias("upper"), outside.alias("outliers"), (outside * 100.0 / F.count(F.lit(1))).alias("outlier_percent")
    )


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distribution of each column; skew and kurtosis are the bias-corrected sample forms."""
    long = long_form(df, cols)
    v = F.col("value")
    n = F.count(v)
    moments = long.groupBy("feature").agg(
        n.alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("_g1"),
        F.kurtosis(v).alias("_g2"),
        F.count_if(v.isNull()).alias("missing"),
        (F.count_if(v.isNull()) * 100.0 / F.count(F.lit(1))).alias("missing_percent"),
    )
    quart = quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    c = F.col("count").cast("double")
    skew = F.when(c > 2, F.col("_g1") * F.sqrt(c * (c - 1)) / (c - 2))
    kurt = F.when(c > 3, F.try_divide(c - 1, (c - 2) * (c - 3)) * ((c + 1) * F.col("_g2") + 6))
    return moments.join(F.broadcast(quart), "feature", "left").withColumns({"skew": skew, "kurtosis": kurt}).drop("_g1", "_g2")


def target_profile(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    v = F.col("value")
    return (
        long_form(df, targets, name="target")
        .groupBy("target")
        .agg(F.count(v).alias("valid"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    )

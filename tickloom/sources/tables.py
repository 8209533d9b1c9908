"""Bar tables derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import TS, timeframe_seconds
from tickloom.operators.resample import floor_ts, ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: one per event, typed size from the property bag."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        TS,
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        "event_id",
        "user_id",
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return ticks_to_bars(trades(spark, sf_dir), timeframe, ties=["event_id"])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals per priority; volume is the number of orders."""
    ticks = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias(TS),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("size"),
        "o_orderkey",
    )
    return ticks_to_bars(ticks, "1d", ties=["o_orderkey"])


def quotes(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Bars with quote columns: low/high as bid/ask and sizes split by even and odd user."""
    ticks = trades(spark, sf_dir)
    even = F.col("user_id") % 2 == 0
    sides = ticks.groupBy("symbol", floor_ts(TS, timeframe_seconds(timeframe)).alias(TS)).agg(
        F.sum(F.when(even, F.col("size")).otherwise(0.0)).alias("bid_volume"),
        F.sum(F.when(~even, F.col("size")).otherwise(0.0)).alias("ask_volume"),
    )
    return (
        ticks_to_bars(ticks, timeframe, ties=["event_id"])
        .join(sides, ["symbol", TS])
        .select(
            "symbol", "timeframe", TS, "open", "high", "low", "close", "volume",
            F.col("low").alias("bid"), F.col("high").alias("ask"), "bid_volume", "ask_volume",
            F.signum(F.col("close") - F.col("open")).alias("trade_direction"),
        )
    )

"""Readers and writers: each query writes given rows in a format under the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import rounded
from registry.sql import HOURLY, bars as bars_sql, pick, with_
from tickloom.config import TS
from tickloom.session import shared_folder
from tickloom.sources import files
from tickloom.sources.tables import bars

QUERIES = {}
SQL = {}

OHLCV = ["open", "high", "low", "close", "volume"]
VALUES = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def query(sql: str, digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, d: rounded(fn(spark, d).drop("timeframe"), digits)
        SQL[fn.__name__] = sql
        return fn

    return register


def plain(frm: str, digits: int = 6) -> str:
    return pick({c: c for c in OHLCV}, digits) + f" FROM {frm}"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/storage-{uuid.uuid4().hex}"


def named_files(df: DataFrame, by: str, name, header: bool) -> str:
    """CSV files named ``name(value)``, one for each value of the column ``by`` (few: symbols or months)."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession)
    df.repartition(by).write.option("header", header).partitionBy(by).csv(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}-named"))
    for part in system.listStatus(path(folder)):
        value = part.getPath().getName().partition("=")[2]
        if value:
            for k, file in enumerate(f for f in system.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")):
                system.rename(file.getPath(), path(f"{folder}-named/{name(value)}{f'-{k}' if k else ''}.csv"))
    return f"{folder}-named"


@query(with_(*HOURLY) + plain("bars_1h"))
def bars_in_csv_files(spark, d):
    """One file a symbol, more columns than bars have, in another order than ours."""
    rows = bars(spark, d).select("symbol", F.lit("x").alias("exchange"), "volume", "close", F.col(TS).alias("timestamp"), "low", "high", "open", F.lit(1.5).alias("sma_5"))
    return files.read_bars_csv(spark, named_files(rows, "symbol", lambda s: f"{s}_1h", True))


def kline_rows(spark, d) -> DataFrame:
    """Header-less rows of the twelve columns, with the file they belong to."""
    ms = F.expr(f"CAST(unix_millis(CAST({TS} AS TIMESTAMP)) AS BIGINT)")
    file = F.concat_ws("_", "symbol", F.lit("1h"), F.date_format(TS, "yyyy"), F.date_format(TS, "MM"))
    return bars(spark, d).select(file.alias("file"), ms.alias("timestamp"), *OHLCV, (ms + 3_599_999).alias("close_time"), *[F.lit(0.0).alias(c) for c in ("quote_volume",)], F.lit(1).alias("count"), F.lit(0.0).alias("b"), F.lit(0.0).alias("q"), F.lit("0").alias("ignore"))


@query(with_(*HOURLY) + plain("bars_1h"))
def bars_in_klines(spark, d):
    return files.read_klines(spark, named_files(kline_rows(spark, d), "file", str, False))


@query(with_(*HOURLY) + plain("bars_1h WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"))
def klines_of_months(spark, d):
    return files.read_months(spark, named_files(kline_rows(spark, d), "file", str, False), (2024, 1), (2024, 1))


@query(with_(*HOURLY) + plain("bars_1h"))
def bars_in_csv_table(spark, d):
    folder = new_folder(spark)
    files.write_csv(bars(spark, d), folder)
    return files.read_parquet_or_csv(spark, folder, VALUES)


@query(with_(*HOURLY, bars_sql("4h")) + plain("bars_1h WHERE symbol <> (SELECT min(symbol) FROM bars_1h)") + " UNION ALL " + pick({c: f"{c} + 1" if c != "volume" else c for c in OHLCV}) + " FROM bars_1h WHERE symbol = (SELECT min(symbol) FROM bars_1h)")
def bars_in_parquet_table(spark, d):
    """Writing one series again replaces that series only."""
    folder, rows = new_folder(spark), bars(spark, d)
    files.write_table(rows, folder)
    first = rows.agg(F.min("symbol")).first()[0]
    files.write_table(rows.filter(F.col("symbol") == first).withColumns({c: F.col(c) + 1 for c in OHLCV[:4]}), folder)
    return files.read_parquet_or_csv(spark, folder, VALUES).select("symbol", TS, *OHLCV)


@query(with_(*HOURLY) + "SELECT symbol, ts, " + ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE) + 1e-6, 3) AS {c}" for c in OHLCV) + " FROM bars_1h", digits=3)
def features_in_single_precision(spark, d):
    folder = new_folder(spark)
    files.write_features(bars(spark, d), folder)
    return files.read_table(spark, folder, timeframe="1h").select("symbol", TS, *[F.col(c).cast("double").alias(c) for c in OHLCV])


@query(with_(*HOURLY) + "SELECT symbol, count(*) AS bars, round(avg(close) + 1e-9, 6) AS mean_close FROM bars_1h GROUP BY 1")
def results_in_json(spark, d):
    folder = new_folder(spark)
    files.write_result(bars(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.avg("close").alias("mean_close")), folder)
    return spark.read.schema("symbol string, bars bigint, mean_close double").json(folder)


@query(with_(*HOURLY) + "SELECT CAST(count(DISTINCT symbol) AS BIGINT) AS files, CAST(1 AS BIGINT) AS wrong FROM bars_1h")
def file_checksums(spark, d):
    """One stated sum is changed, and found."""
    folder = named_files(bars(spark, d).drop("timeframe"), "symbol", lambda s: f"{s}_1h", True)
    stated = spark.read.format("binaryFile").load(f"{folder}/*.csv").select(F.sha2("content", 256).alias("sum"), F.element_at(F.split("path", "/"), -1).alias("file"))
    first = stated.agg(F.min("file")).first()[0]
    line = F.concat_ws("  ", F.when(F.col("file") == first, F.reverse("sum")).otherwise(F.col("sum")), "file")
    stated.select(line.alias("value")).write.text(f"{folder}-sums")
    return files.verify_checksums(spark, f"{folder}/*.csv", f"{folder}-sums/*.txt").agg(F.count("*").alias("files"), F.count(F.when(~F.col("valid"), 1)).alias("wrong"))


@query("SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN upper(event_type) || '/USDT' ELSE event_type END AS pair, count(*) AS rows FROM events GROUP BY 1, 2")
def pair_names(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    symbol = F.when(F.col("user_id") % 2 == 0, F.concat(F.upper("event_type"), F.lit("USDT"))).otherwise(F.col("event_type"))
    return events.select(F.col("event_type").alias("symbol"), files.pair_name(symbol).alias("pair")).groupBy("symbol", "pair").agg(F.count("*").alias("rows"))

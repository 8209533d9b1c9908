"""Readers and writers of bar files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.config import KEYS, TS

BARS = T.StructType(
    [T.StructField(TS, T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

# The twelve columns of a header-less kline dump.
KLINE = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("close_time", T.LongType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("taker_buy_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_volume", T.DoubleType()),
        T.StructField("ignore", T.StringType()),
    ]
)

# File names look like SYMBOL_TIMEFRAME_YYYY_MM.csv or SYMBOL_TIMEFRAME.csv.
NAME = r"([A-Za-z0-9]+)_(\d+[mhdw])(?:_(\d{4})_(\d{2}))?[^/]*$"


def file_part(group: int) -> Column:
    part = F.regexp_extract(F.col("_metadata.file_name"), NAME, group)
    return F.when(part != "", part)


def epoch_ms(ms: str) -> Column:
    """Zone-free timestamp of an epoch in milliseconds."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + CAST({ms} AS BIGINT) * INTERVAL '0.001' SECOND")


def read_bars_csv(spark: SparkSession, path: str | Sequence[str], header_time: str = "timestamp") -> DataFrame:
    """Bar CSV files; symbol and timeframe come from the file names.

    Columns are found by the header, in any order and among any others; the files of one call share their header.
    """
    df = spark.read.option("header", True).csv(path)
    values = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in BARS.fields[1:]]
    return df.select(file_part(1).alias("symbol"), file_part(2).alias("timeframe"), F.col(f"`{header_time}`").cast("timestamp_ntz").alias(TS), *values)


def read_klines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Kline dumps projected to bars; files split across tasks and unused columns are not parsed."""
    df = spark.read.schema(KLINE).csv(path)
    return df.select(file_part(1).alias("symbol"), file_part(2).alias("timeframe"), epoch_ms("timestamp").alias(TS), "open", "high", "low", "close", "volume")


def read_months(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int], reader=read_klines) -> DataFrame:
    """Only files whose name carries a month inside ``first``..``last`` (year, month)."""
    month = F.coalesce(file_part(3).cast("int") * 12 + file_part(4).cast("int"), F.lit(-1))
    if reader is read_klines:
        raw = spark.read.schema(KLINE).csv(path)
        raw = raw.filter(month.between(first[0] * 12 + first[1], last[0] * 12 + last[1]))
        return raw.select(file_part(1).alias("symbol"), file_part(2).alias("timeframe"), epoch_ms("timestamp").alias(TS), "open", "high", "low", "close", "volume")
    raise ValueError("month ranges apply to kline dumps")


def parse_ohlcv_arrays(df: DataFrame, column: str, keep: Sequence[str] = KEYS) -> DataFrame:
    """Rows from a JSON array of ``[epoch ms, open, high, low, close, volume]`` lists."""
    rows = df.select(*keep, F.explode(F.from_json(column, "array<array<double>>")).alias("_r"))
    cells = [F.element_at("_r", i + 2).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))]
    return rows.select(*keep, epoch_ms("element_at(_r, 1)").alias(TS), *cells)


def read_table(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, timeframe: str | None = None) -> DataFrame:
    """Partitioned bar or feature table; the filters prune partitions."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if timeframe is not None:
        df = df.filter(F.col("timeframe") == timeframe)
    return df


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that ``write_csv`` wrote: columns by the header, symbol and timeframe from the folders."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_parquet_or_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet files under ``path``, or its CSV files if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return spark.read.parquet(path)
    return read_csv_table(spark, path, schema)


def pair_name(symbol: Column) -> Column:
    """BTC/USDT from BTCUSDT; other symbols stay."""
    return F.regexp_replace(symbol, "^(.*)USDT$", "$1/USDT")


def read_with_fallback(spark: SparkSession, preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """All series of ``preferred`` plus those only ``fallback`` has, e.g. processed before raw."""
    have = preferred.select(*KEYS).distinct()
    return preferred.unionByName(fallback.join(have, list(KEYS), "left_anti"))


def discover(df: DataFrame) -> DataFrame:
    """The series present in a table."""
    return df.select(*KEYS).distinct()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd", rows_per_file: int = 5_000_000) -> None:
    """Parquet by symbol and timeframe, split by time so a large series fills several tasks.

    ``overwrite`` replaces the series that ``df`` has and leaves the others in the table.
    """
    spread = df.withColumn("_month", F.trunc(TS, "month")).repartition(*KEYS, "_month").sortWithinPartitions(*KEYS, TS).drop("_month")
    spread.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature tables are stored in single precision with gzip; computing stays in double."""
    narrow = df.select(*[F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])
    write_table(narrow, path, mode, "gzip")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).partitionBy(*KEYS).csv(path)


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Selections and metrics: JSON or parquet."""
    df.write.mode(mode).format(fmt).save(path)


def verify_checksums(spark: SparkSession, data_glob: str, checksum_glob: str) -> DataFrame:
    """Each file with its stated and actual SHA-256. Content is hashed where it is read."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(data_glob).select(name.alias("file"), F.sha2("content", 256).alias("actual"))
    stated = spark.read.text(checksum_glob).select(F.split(F.trim("value"), r"\s+\*?").alias("p")).select(F.lower(F.element_at("p", 1)).alias("stated"), F.element_at("p", -1).alias("file"))
    return files.join(stated, "file", "left").withColumn("valid", F.coalesce(F.col("actual") == F.col("stated"), F.lit(False)))


def month_ranges(df: DataFrame, months: int = 1, start: str = "start", end: str = "end", keep: Sequence[str] = KEYS) -> DataFrame:
    """Consecutive ranges of ``months`` months covering ``start``..``end`` of each row."""
    first = F.trunc(start, "month")
    starts = F.sequence(first, F.to_date(end), F.make_ym_interval(months=F.lit(months)))
    out = df.select(*keep, F.explode(starts).alias("range_start"))
    return out.withColumn("range_end", F.date_sub(F.add_months("range_start", months), 1))


def missing_months(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (symbol, timeframe, range_start) months without a single loaded bar."""
    loaded = bars.select(*KEYS, F.trunc(TS, "month").alias("range_start")).distinct()
    return wanted.join(loaded, [*KEYS, "range_start"], "left_anti")

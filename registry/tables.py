"""Resampling, cleaning, quality, alignment, label and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import rounded
from registry.sql import HOURLY, TRADES, bars as bars_sql, div, floor_ts, lag, over, pick, rnd, with_
from tickloom.operators import align, clean, labels, prep, quality
from tickloom.operators.ranks import quantiles
from tickloom.operators.resample import resample, resample_with
from tickloom.sources import files
from tickloom.sources.tables import bars, order_bars, table, trades

QUERIES = {}
SQL = {}

OHLCV = ["open", "high", "low", "close", "volume"]


def query(sql: str | None = None, digits: int = 6):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def plain(frm: str, cols=OHLCV) -> str:
    return pick({c: c for c in cols}) + f" FROM {frm}"


# --- resampling --------------------------------------------------------------------------------
for tf in ("1h", "4h", "1d"):
    QUERIES[f"bars_{tf}"] = lambda spark, d, tf=tf: rounded(bars(spark, d, tf).drop("timeframe"))
    SQL[f"bars_{tf}"] = with_(TRADES, bars_sql(tf)) + plain(f"bars_{tf}")


@query(
    "WITH b AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open,"
    " max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume"
    " FROM orders GROUP BY 1, 2) SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, " + ", ".join(f"{rnd(c)} AS {c}" for c in OHLCV) + " FROM b"
)
def bars_1d_daily_orders(spark, d):
    return order_bars(spark, d).drop("timeframe")


COARSE = f"""c AS (SELECT symbol, {floor_ts('ts', 14400)} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars_1h GROUP BY 1, 2)"""


@query(with_(*HOURLY, COARSE) + plain("c"))
def resample_1h_to_4h(spark, d):
    return resample(bars(spark, d), "4h").drop("timeframe")


GRID = """ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars_1h GROUP BY 1),
grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends),
g AS (SELECT grid.symbol, grid.ts, open, high, low, close, coalesce(volume, 0) AS volume FROM grid LEFT JOIN bars_1h b ON b.symbol = grid.symbol AND b.ts = grid.ts)"""


@query(with_(*HOURLY, GRID) + plain("g"))
def bars_with_gap_rows(spark, d):
    return resample(bars(spark, d), "1h", fill_gaps=True).drop("timeframe")


FFILL = {c: over(f"last_value({c} IGNORE NULLS)", "UNBOUNDED PRECEDING AND CURRENT ROW") for c in ("open", "high", "low", "close")}


@query(with_(*HOURLY, GRID) + pick({**FFILL, "volume": "volume"}) + " FROM g")
def bars_gap_filled(spark, d):
    return clean.fill_bars(resample(bars(spark, d), "1h", fill_gaps=True)).drop("timeframe")


@query(
    with_(*HOURLY)
    + f"SELECT symbol, {floor_ts('ts', 86400)} AS ts, {rnd('avg(close)')} AS close, {rnd('avg(volume)')} AS volume, last(up ORDER BY ts) AS up"
    + " FROM (SELECT *, CASE WHEN close > open THEN 'up' ELSE 'down' END AS up FROM bars_1h) GROUP BY 1, 2"
)
def resample_generic(spark, d):
    b = bars(spark, d).withColumn("up", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    return resample_with(b.select("symbol", "ts", "close", "volume", "up"), "1d")


@query(
    with_(*HOURLY)
    + f"SELECT symbol, {floor_ts('ts', 86400)} AS ts, {rnd('stddev_samp(close)')} AS close, max(high) AS high, {rnd('sum(volume)')} AS volume, count(open) AS open FROM bars_1h GROUP BY 1, 2"
)
def resample_custom(spark, d):
    return resample_with(bars(spark, d), "1d", {"close": "std", "high": "max", "volume": "sum", "open": "count"})


# --- cleaning ----------------------------------------------------------------------------------
# Revised bars: every 7th hour of the epoch is delivered again with another close, every 11th
# has lost its close.
def dirty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, d)
    hour = F.expr("datediff(ts, DATE'1970-01-01') * 24L + hour(ts)")
    first = b.withColumn("close", F.when(hour % 11 != 0, F.col("close")))
    again = b.filter(hour % 7 == 0).withColumn("close", F.col("close") + 1)
    return first, again


DIRTY = """h AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS hr FROM bars_1h),
d AS (SELECT symbol, ts, open, high, low, CASE WHEN hr % 11 <> 0 THEN close END AS close, volume, 0 AS src FROM h
  UNION ALL SELECT symbol, ts, open, high, low, close + 1, volume, 1 FROM h WHERE hr % 7 = 0)"""


def kept(order: str) -> str:
    return with_(*HOURLY, DIRTY) + pick({c: c for c in OHLCV}) + f" FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY src {order}) AS rn FROM d) WHERE rn = 1"


@query(kept("ASC"))
def dedupe_first(spark, d):
    return clean.append_sources(dirty(spark, d), "first").drop("timeframe")


@query(kept("DESC"))
def dedupe_last(spark, d):
    return clean.append_sources(dirty(spark, d), "last").drop("timeframe")


@query(with_(*HOURLY) + plain("bars_1h") + " WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def date_range(spark, d):
    return clean.between(bars(spark, d), "2024-01-05 00:00:00", "2024-01-09 12:00:00").drop("timeframe")


HOLES = f"x AS (SELECT symbol, ts, CASE WHEN {lag('close', 3)} IS NOT NULL AND volume > 60 THEN close END AS close FROM bars_1h)"


def holes(spark, d):
    """Closes known only for busy bars from the fourth on."""
    b = labels.rolling(bars(spark, d), [lambda w: {"_p": F.lag("close", 3).over(w)}], back=3)
    return b.select("symbol", "timeframe", "ts", F.when(F.col("_p").isNotNull() & (F.col("volume") > 60), F.col("close")).alias("close"))


FB = f"coalesce({over('last_value(close IGNORE NULLS)', 'UNBOUNDED PRECEDING AND CURRENT ROW')}, {over('first_value(close IGNORE NULLS)', 'CURRENT ROW AND UNBOUNDED FOLLOWING')})"


@query(with_(*HOURLY, HOLES) + pick({"close": FB}) + " FROM x")
def fill_both_ways(spark, d):
    return clean.fill_both_ways(holes(spark, d), ["close"]).drop("timeframe")


@query(with_(*HOURLY, HOLES) + pick({"close": f"coalesce({FB}, 0)"}) + " FROM x")
def fill_model_input(spark, d):
    return clean.model_input(holes(spark, d), ["close"]).drop("timeframe")


@query(with_(*HOURLY, HOLES) + pick({"close": "coalesce(close, (SELECT avg(close) FROM x))"}) + " FROM x")
def fill_mean(spark, d):
    return clean.fill_mean(holes(spark, d), ["close"]).drop("timeframe")


@query(with_(*HOURLY, HOLES) + pick({"close": "coalesce(close, avg(close) OVER (PARTITION BY symbol), 0)"}) + " FROM x")
def repair_target(spark, d):
    return clean.repair_target(holes(spark, d), "close").drop("timeframe")


@query(with_(*HOURLY, HOLES) + pick({"close": "close"}) + " FROM x WHERE close IS NOT NULL")
def drop_incomplete(spark, d):
    return clean.drop_incomplete(holes(spark, d), ["close"]).drop("timeframe")


@query(
    with_(*HOURLY, HOLES)
    + f"SELECT 'close' AS target, count(*) AS rows, {rnd('avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0 END)')} AS missing_share, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0 END) <= 0.7 AS usable FROM x"
)
def target_gate(spark, d):
    return clean.target_gate(holes(spark, d), ["close"])


@query(
    f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 2 THEN date_trunc('second', ts) END AS parsed FROM events"
)
def parse_times(spark, d):
    e = table(spark, d, "events")
    shape = F.col("event_id") % 4
    text = (
        F.when(shape == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(shape == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(shape == 2, F.date_format("ts", "yyyyMMdd HH:mm:ss"))
        .otherwise("not a time")
    )
    return e.select("event_id", clean.parse_time(text).alias("parsed"))


@query(
    with_(*HOURLY)
    + pick({"close": "close"}, keys=f"symbol, TIMESTAMP '2025-01-01 00:00:00' + to_minutes({over('row_number()')} - 1) AS ts")
    + " FROM bars_1h"
)
def minute_index(spark, d):
    return clean.minute_index(bars(spark, d), "2025-01-01 00:00:00").select("symbol", "ts", "close")


@query(with_(*HOURLY) + f"SELECT symbol, ts, {rnd('close')} AS \"1h_close\", {rnd('volume')} AS \"1h_volume\" FROM bars_1h")
def project_prefixed(spark, d):
    named = clean.project(clean.numeric_only(bars(spark, d)), "core", {"core": ["close", "volume"]})
    return clean.prefixed(named, "1h").drop("timeframe")


@query(with_(*HOURLY) + pick({"close": "close"}, keys="symbol, ts, CAST(rn AS INTEGER) AS recency") + " FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars_1h) WHERE rn <= 10")
def latest_n_bars(spark, d):
    return clean.latest(bars(spark, d), 10).select("symbol", "ts", "recency", "close")


# --- sources on derived data -------------------------------------------------------------------
@query(with_(*HOURLY) + plain("bars_1h"))
def ohlcv_json_arrays(spark, d):
    b = bars(spark, d)
    ms = F.expr("(CAST(datediff(ts, DATE'1970-01-01') AS BIGINT) * 86400 + hour(ts) * 3600) * 1000")
    cells = F.array(ms.cast("double"), *[F.col(c) for c in OHLCV])
    # One document per symbol and day, as an exchange would answer a day's request.
    docs = b.groupBy("symbol", "timeframe", F.to_date("ts").alias("day")).agg(F.to_json(F.collect_list(cells)).alias("body"))
    return files.parse_ohlcv_arrays(docs, "body").drop("timeframe")


MONTHS = "m AS (SELECT symbol, CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE) AS range_start FROM (SELECT symbol, min(ts) AS lo, max(ts) + INTERVAL 70 DAY AS hi FROM bars_1h GROUP BY 1))"


def wanted_months(spark, d):
    ends = bars(spark, d).groupBy("symbol", "timeframe").agg(F.min("ts").alias("start"), (F.max("ts") + F.make_dt_interval(days=F.lit(70))).alias("end"))
    return files.month_ranges(ends)


@query(with_(*HOURLY, MONTHS) + "SELECT symbol, range_start, CAST(range_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS range_end FROM m")
def month_ranges(spark, d):
    return wanted_months(spark, d).drop("timeframe")


@query(with_(*HOURLY, MONTHS) + "SELECT m.symbol, range_start FROM m WHERE NOT EXISTS (SELECT 1 FROM bars_1h b WHERE b.symbol = m.symbol AND CAST(date_trunc('month', b.ts) AS DATE) = m.range_start)")
def missing_months(spark, d):
    return files.missing_months(bars(spark, d), wanted_months(spark, d)).select("symbol", "range_start")


@query(with_(*HOURLY) + "SELECT DISTINCT symbol, '1h' AS timeframe FROM bars_1h")
def discover_series(spark, d):
    return files.discover(bars(spark, d))


# --- quality -----------------------------------------------------------------------------------
@query(
    with_(*HOURLY, DIRTY)
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM d" for c in OHLCV)
)
def quality_nulls(spark, d):
    a, b = dirty(spark, d)
    return quality.null_counts(a.unionByName(b), OHLCV)


@query("WITH q AS (SELECT l_quantity, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM q")
def quality_duplicates(spark, d):
    return quality.duplicate_rows(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT event_type AS symbol, count(*) FILTER (WHERE ts < p) AS out_of_order FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1")
def quality_unsorted(spark, d):
    return quality.unsorted_times(trades(spark, d), "event_id", ["symbol"])


@query(
    with_(*HOURLY, f"s AS (SELECT symbol, CAST(epoch(ts) - epoch({lag('ts')}) AS BIGINT) AS step FROM bars_1h), c AS (SELECT symbol, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2)")
    + f"SELECT symbol, arg_max(step, n) AS common_step, CAST(sum(n) AS BIGINT) AS steps, CAST(sum(n) - max(n) AS BIGINT) AS irregular, {rnd('(sum(n) - max(n)) * 100.0 / sum(n)')} AS irregular_percent FROM c GROUP BY 1"
)
def quality_intervals(spark, d):
    return quality.irregular_intervals(bars(spark, d)).drop("timeframe")


def unpivot(frm: str, cols: list[str], name: str = "feature") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS {name}, CAST({c} AS DOUBLE) AS value FROM {frm}" for c in cols)


@query(
    with_(*HOURLY, f"l AS ({unpivot('bars_1h', OHLCV)})", "q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1)",
          "b AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)")
    + f"SELECT feature, {rnd('any_value(lo)')} AS lower, {rnd('any_value(hi)')} AS upper, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers, {rnd('count(*) FILTER (WHERE value < lo OR value > hi) * 100.0 / count(*)')} AS outlier_percent FROM l JOIN b USING (feature) GROUP BY feature"
)
def quality_outliers(spark, d):
    return quality.outliers(bars(spark, d), OHLCV)


PROFILE = """SELECT feature, count(value) AS count, {mean} AS mean, {std} AS std, min(value) AS min, max(value) AS max, count(*) - count(value) AS missing,
  {mp} AS missing_percent, {q25} AS q25, {q50} AS q50, {q75} AS q75, {skew} AS skew, {kurt} AS kurtosis FROM l GROUP BY 1""".format(
    mean=rnd("avg(value)"), std=rnd("stddev_samp(value)"), mp=rnd("(count(*) - count(value)) * 100.0 / count(*)"),
    q25=rnd("quantile_cont(value, 0.25)"), q50=rnd("quantile_cont(value, 0.5)"), q75=rnd("quantile_cont(value, 0.75)"),
    skew=rnd("skewness(value)"), kurt=rnd("kurtosis(value)"),
)


@query(with_(*HOURLY, DIRTY, f"l AS ({unpivot('d', ['open', 'close', 'volume'])})") + PROFILE)
def distribution_profile(spark, d):
    a, b = dirty(spark, d)
    return quality.profile(a.unionByName(b), ["open", "close", "volume"])


@query(f"WITH l AS ({unpivot('lineitem', ['l_quantity', 'l_discount', 'l_extendedprice'])}) " + PROFILE, digits=5)
def profile_lineitem(spark, d):
    return quality.profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


SQL["profile_lineitem"] = SQL["profile_lineitem"].replace("1e-9, 6)", "1e-8, 5)")


@query(
    with_(*HOURLY, HOLES)
    + f"SELECT 'close' AS target, count(close) AS valid, count(*) - count(close) AS missing, {rnd('avg(close)')} AS mean, {rnd('stddev_samp(close)')} AS std, min(close) AS min, max(close) AS max FROM x"
)
def target_profile(spark, d):
    return quality.target_profile(holes(spark, d), ["close"])


@query(
    f"SELECT event_type AS symbol, {rnd('quantile_cont(value, 0.1)')} AS p10, {rnd('quantile_cont(value, 0.5)')} AS p50, {rnd('quantile_cont(value, 0.99)')} AS p99 FROM events GROUP BY 1"
)
def exact_quantiles(spark, d):
    return quantiles(trades(spark, d), ["symbol"], "price", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


# --- alignment ---------------------------------------------------------------------------------
ALL = (TRADES, bars_sql("1h"), bars_sql("4h"), bars_sql("1d"))


def asof_sql(shift: bool) -> str:
    move = {tf: f"SELECT symbol, ts{f' + INTERVAL {n}' if shift else ''} AS ts, close, volume FROM bars_{tf}" for tf, n in (("4h", "4 HOUR"), ("1d", "1 DAY"))}
    return (
        with_(*ALL, *[f"s{tf} AS ({q})" for tf, q in move.items()])
        + f"SELECT b.symbol, b.ts, {rnd('b.close')} AS close, {rnd('x.close')} AS \"4h_close\", {rnd('x.volume')} AS \"4h_volume\", {rnd('y.close')} AS \"1d_close\", {rnd('y.volume')} AS \"1d_volume\" "
        + "FROM bars_1h b ASOF LEFT JOIN s4h x ON b.symbol = x.symbol AND b.ts >= x.ts ASOF LEFT JOIN s1d y ON b.symbol = y.symbol AND b.ts >= y.ts"
    )


def asof_tables(spark, d, available):
    base = bars(spark, d).select("symbol", "ts", "close")
    return align.asof(base, {tf: bars(spark, d, tf).select("symbol", "ts", "close", "volume") for tf in ("4h", "1d")}, available=available)


@query(asof_sql(False))
def asof_multi_timeframe(spark, d):
    return asof_tables(spark, d, False)


@query(asof_sql(True))
def asof_available(spark, d):
    return asof_tables(spark, d, True)


@query(
    with_(*ALL, "s AS (SELECT symbol, ts + INTERVAL 4 HOUR AS ts, close FROM bars_4h)",
          "j AS (SELECT b.symbol, b.ts, b.close AS c1, b.volume AS v1, x.close AS c4 FROM bars_1h b ASOF LEFT JOIN s x ON b.symbol = x.symbol AND b.ts >= x.ts)")
    + f"SELECT symbol, ts, {rnd('c1')} AS \"1h_close\", {rnd('v1')} AS \"1h_volume\", {rnd('coalesce(' + over('last_value(c4 IGNORE NULLS)', 'UNBOUNDED PRECEDING AND CURRENT ROW') + ', ' + over('first_value(c4 IGNORE NULLS)', 'CURRENT ROW AND UNBOUNDED FOLLOWING') + ')')} AS \"4h_close\" FROM j"
)
def integrate_timeframes(spark, d):
    tables = {tf: bars(spark, d, tf) for tf in ("1h", "4h")}
    return align.integrate(tables, "1h", {"1h": ["close", "volume"], "4h": ["close"]}, fill=True)


@query(
    with_(*ALL, "e AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars_4h GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e)")
    + f"SELECT g.symbol, g.ts, {rnd('x.close')} AS close FROM g ASOF LEFT JOIN bars_4h x ON g.symbol = x.symbol AND g.ts >= x.ts"
)
def upsample_4h_to_1h(spark, d):
    return align.upsample(bars(spark, d, "4h").select("symbol", "ts", "close"), "1h")


@query(
    with_(*ALL, "l AS (SELECT symbol, ts, 1 AS l FROM bars_1h), r AS (SELECT symbol, ts, 1 AS r, CASE WHEN volume > 200 THEN close END AS y FROM bars_4h)")
    + "SELECT count(l) AS left_rows, count(r) AS right_rows, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common_rows, count(*) FILTER (WHERE l IS NOT NULL AND y IS NOT NULL) AS common_valid,"
    + " min(CASE WHEN l = 1 THEN ts END) AS left_min, max(CASE WHEN l = 1 THEN ts END) AS left_max, min(CASE WHEN r = 1 THEN ts END) AS right_min, max(CASE WHEN r = 1 THEN ts END) AS right_max,"
    + " max(CASE WHEN r = 1 THEN ts END) < min(CASE WHEN l = 1 THEN ts END) AS right_before_left, min(CASE WHEN r = 1 THEN ts END) > max(CASE WHEN l = 1 THEN ts END) AS right_after_left"
    + " FROM l FULL OUTER JOIN r USING (symbol, ts)"
)
def index_diagnostics(spark, d):
    right = bars(spark, d, "4h").withColumn("y", F.when(F.col("volume") > 200, F.col("close")))
    return align.diagnose(bars(spark, d), right, "y")


@query(with_(*ALL) + f"SELECT a.symbol, a.ts, {rnd('a.close')} AS close, {rnd('b.close')} AS target FROM bars_1h a JOIN bars_4h b ON a.symbol = b.symbol AND a.ts = b.ts")
def inner_align(spark, d):
    return align.inner(bars(spark, d).select("symbol", "ts", "close"), bars(spark, d, "4h").select("symbol", "ts", F.col("close").alias("target")), ["symbol", "ts"])


# --- labels ------------------------------------------------------------------------------------
H = (1, 4, 24, 72)


def label_sql(forward: bool) -> str:
    cols = {f"target_pct_{h}": (f"({div(over(f'lead(close, {h})'), 'close')} - 1) * 100" if forward else f"({div('close', lag('close', h))} - 1) * 100") for h in H}
    x = "x AS (SELECT symbol, ts, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM bars_1h)"
    flags = ", ".join(f"CAST(CASE WHEN target_pct_{h} > 0 THEN 1 ELSE 0 END AS INTEGER) AS target_direction_{h}" for h in H)
    return with_(*HOURLY, x) + pick({n: n for n in cols}) + f", {flags} FROM x"


@query(label_sql(True))
def labels_forward(spark, d):
    return labels.targets(bars(spark, d), H, "forward", volatility=False).drop("timeframe", *OHLCV)


@query(label_sql(False))
def labels_trailing(spark, d):
    return labels.targets(bars(spark, d), H, "trailing", volatility=False).drop("timeframe", *OHLCV)


@query(
    with_(*HOURLY, f"x AS (SELECT *, {div('close', lag('close'))} - 1 AS r FROM bars_1h)")
    + pick({f"target_volatility_{h}": f"CASE WHEN {over(f'lead(close, {h})')} IS NOT NULL THEN {over('stddev_samp(r)', f'1 FOLLOWING AND {h - 1} FOLLOWING')} * sqrt(252.0) END" for h in (4, 24, 72)})
    + " FROM x"
)
def label_volatility(spark, d):
    out = labels.targets(bars(spark, d), (4, 24, 72))
    return out.select("symbol", "ts", *[f"target_volatility_{h}" for h in (4, 24, 72)])


@query(
    with_(TRADES, bars_sql("1m"), f"x AS (SELECT *, {div('close', lag('close'))} - 1 AS r FROM bars_1m)")
    + pick({f"target_volatility_{h}": f"CASE WHEN {over(f'lead(close, {h})')} IS NOT NULL THEN {over('stddev_samp(r)', f'1 FOLLOWING AND {h - 1} FOLLOWING')} * sqrt(252.0) END" for h in (60, 240, 1440)})
    + " FROM x"
)
def label_volatility_of_minutes(spark, d):
    """Horizons of up to a day of minutes."""
    out = labels.targets(bars(spark, d, "1m"), (60, 240, 1440))
    return out.select("symbol", "ts", *[f"target_volatility_{h}" for h in (60, 240, 1440)])


@query(with_(*HOURLY) + pick({f"{c}_lag_{n}": lag(c, n) for c in ("close", "volume") for n in (1, 2, 3, 5, 10)}) + " FROM bars_1h")
def lag_features(spark, d):
    return labels.lags(bars(spark, d), ["close", "volume"]).drop("timeframe", *OHLCV)


@query(with_(*HOURLY) + pick({"price_change_1h": f"{div('close', lag('close', 1))} - 1", "price_change_4h": f"{div('close', lag('close', 4))} - 1", "price_change_1d": f"{div('close', lag('close', 24))} - 1"}) + " FROM bars_1h")
def fallback_labels(spark, d):
    return labels.recent_changes(bars(spark, d)).drop("timeframe", *OHLCV)


SEQ = 8


@query(
    with_(*HOURLY, f"x AS (SELECT symbol, ts, close, {over('list(close)', f'{SEQ} PRECEDING AND 1 PRECEDING')} AS seq, {over('count(*)', f'{SEQ} PRECEDING AND 1 PRECEDING')} AS n, {over('list(volume)', f'{SEQ} PRECEDING AND 1 PRECEDING')} AS vs FROM bars_1h)")
    + f"SELECT symbol, ts, i AS step, {rnd('seq[i]')} AS close, {rnd('vs[i]')} AS volume, {rnd('close')} AS label FROM x, (SELECT CAST(unnest(range(1, {SEQ + 1})) AS INTEGER) AS i) WHERE n = {SEQ}"
)
def sequence_windows(spark, d):
    out = labels.sequences(bars(spark, d), ["close", "volume"], SEQ, "close")
    return out.select("symbol", "ts", "label", F.posexplode("sequence").alias("step", "s")).select("symbol", "ts", (F.col("step") + 1).alias("step"), "s.close", "s.volume", "label")


# --- preprocessing -----------------------------------------------------------------------------
COLS = ["close", "volume"]
STATS = "st AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s, stddev_pop({c}) AS {c}_p, min({c}) AS {c}_lo, max({c}) AS {c}_hi, quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.5) AS {c}_2, quantile_cont({c}, 0.75) AS {c}_3" for c in COLS
) + " FROM bars_1h)"


def prep_sql(make) -> str:
    return with_(*HOURLY, STATS) + pick({c: make(c) for c in COLS}) + " FROM bars_1h, st"


def prepared(fn, quartiles=False):
    def run(spark, d):
        b = bars(spark, d)
        return fn(b, prep.fit_stats(b, COLS, quartiles)).select("symbol", "ts", *COLS)

    return run


for name, fn, quart, make in (
    ("iqr_clip", prep.clip_iqr, True, lambda c: f"least(greatest({c}, {c}_1 - 1.5 * ({c}_3 - {c}_1)), {c}_3 + 1.5 * ({c}_3 - {c}_1))"),
    ("zscore_mask", prep.mask_zscore, False, lambda c: f"CASE WHEN abs({c} - {c}_m) > 3 * {c}_s THEN {c}_m ELSE {c} END"),
    ("scale_standard", prep.scale_standard, False, lambda c: f"({c} - {c}_m) / {c}_p"),
    ("scale_minmax", prep.scale_minmax, False, lambda c: f"({c} - {c}_lo) / ({c}_hi - {c}_lo)"),
    ("scale_robust", prep.scale_robust, True, lambda c: f"({c} - {c}_2) / ({c}_3 - {c}_1)"),
):
    QUERIES[name] = lambda spark, d, run=prepared(fn, quart): rounded(run(spark, d))
    SQL[name] = prep_sql(make)

CLIPPED = "cl AS (SELECT symbol, ts, " + ", ".join(f"least(greatest({c}, {c}_1 - 1.5 * ({c}_3 - {c}_1)), {c}_3 + 1.5 * ({c}_3 - {c}_1)) AS {c}" for c in COLS) + " FROM bars_1h, st)"


@query(
    with_(*HOURLY, STATS, CLIPPED, "s2 AS (SELECT " + ", ".join(f"avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_b" for c in COLS) + " FROM cl)")
    + pick({c: f"({c} - {c}_a) / {c}_b" for c in COLS}) + " FROM cl, s2"
)
def preprocess_chain(spark, d):
    b = bars(spark, d)
    return prep.Preprocessor(COLS).fit(b).transform(b).select("symbol", "ts", *COLS)

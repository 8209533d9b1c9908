"""Training across bar sizes, with the fit in closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import fits
from registry.common import rounded
from registry.sql import STEP, TRADES, bars as bars_sql, div, lag, rnd, with_
from tickloom.config import FeatureConfig
from tickloom.plans import cross_timeframe as cross
from tickloom.sources.tables import bars

COLUMNS = {"1h": ["price_gap", "open_close_diff"], "4h": ["price_gap", "price_change_pct"], "1d": ["open_close_diff", "high_low_diff"]}
NAMES = [f'"{tf}_{c}"' for tf, cols in COLUMNS.items() for c in cols]
CONFIG = FeatureConfig(groups=("price_based",))


def features_sql(tf: str) -> str:
    made = {"price_gap": div("high - low", "low"), "high_low_diff": div("high - low", "low"), "open_close_diff": div("close - open", "open"), "price_change_pct": f"{div('close', lag('close'))} - 1"}
    later = f"ts + INTERVAL {STEP[tf]} SECOND" if tf != "1h" else "ts"
    extra = ", (lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1) * 100 AS y" if tf == "1h" else ""
    return f"f{tf} AS (SELECT symbol, {later} AS ts, " + ", ".join(f'{made[c]} AS "{tf}_{c}"' for c in COLUMNS[tf]) + f"{extra} FROM bars_{tf})"


TABLE = (
    TRADES, *[bars_sql(tf) for tf in COLUMNS], *[features_sql(tf) for tf in COLUMNS],
    "jo AS (SELECT b.*, x.* EXCLUDE (symbol, ts), d.* EXCLUDE (symbol, ts) FROM f1h b ASOF LEFT JOIN f4h x ON b.symbol = x.symbol AND b.ts >= x.ts ASOF LEFT JOIN f1d d ON b.symbol = d.symbol AND b.ts >= d.ts)",
)
RANKED = "po AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS i, count(*) OVER () AS n FROM jo WHERE y IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in NAMES) + ")"
ROLES = "fo AS (SELECT *, 0 AS k, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'none' ELSE 'test' END AS role FROM po)"
ALL = (1 << len(NAMES)) - 1


def table(spark, d):
    return cross.cross_timeframe_table({tf: bars(spark, d, tf) for tf in COLUMNS}, "1h", COLUMNS, [1], CONFIG, volatility=False)


def cross_timeframe_columns(spark, d):
    return rounded(table(spark, d).select("symbol", "ts", *[F.col(c.strip('"')) for c in NAMES], "target_pct_1"))


def cross_timeframe_training(spark, d):
    return rounded(cross.train_cross_timeframe(table(spark, d), "target_pct_1")[2], 5)


QUERIES = {f.__name__: f for f in (cross_timeframe_columns, cross_timeframe_training)}
SQL = {
    "cross_timeframe_columns": with_(*TABLE) + "SELECT symbol, ts, " + ", ".join(f"{rnd(c)} AS {c}" for c in NAMES) + f", {rnd('y')} AS target_pct_1 FROM jo",
    "cross_timeframe_training": with_(*TABLE, RANKED, ROLES, fits.candidates([(0, 0.0, ALL)]), *fits.fits("fo", "", (*NAMES, "y")), f"te AS (SELECT y, {fits.fitted('', (*NAMES, 'y'))} AS p FROM fo JOIN bi USING (k) WHERE role = 'test')")
    + f"SELECT count(*) AS rows, {rnd('avg(pow(y - p, 2))', 5)} AS mse, "
    + ", ".join(f"{rnd(e, 5)} AS {m}" for m, e in fits.METRIC_SQL.items())
    + " FROM te",
}

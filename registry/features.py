"""Indicator queries over the hourly bars."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import rounded
from registry.sql import HOURLY, QUOTES, TRADES, bars as bars_sql, cumulative, div, filled, lag, over, pick, recur, roll, trailing, with_
from tickloom.functions import micro, momentum, price, signals, trend, volatility, volume
from tickloom.functions.core import Family, compute
from tickloom.session import cut_lineage
from tickloom.sources.tables import bars, quotes

QUERIES = {}
SQL = {}


def without_bar(df: DataFrame) -> DataFrame:
    return df.drop("timeframe", "open", "high", "low", "close", "volume", "bid", "ask", "bid_volume", "ask_volume", "trade_direction")


def add(name: str, families: Callable[[], list[Family]], sql: str, digits: int = 6, source=bars, keep: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = families()
        cut = cut_lineage if any(f.scans for f in wanted) else None
        out = without_bar(compute(source(spark, sf_dir), *wanted, cut=cut))
        return rounded(out.select("symbol", "ts", *keep) if keep else out, digits)

    QUERIES[name] = run
    SQL[name] = sql


W4 = (5, 10, 20, 50)
RET = f"{div('close', lag('close'))} - 1"
TP = "((high + low + close) / 3)"
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"

# --- price -------------------------------------------------------------------------------------
cols = {
    "price_change_pct": "r",
    "price_gap": div("high - low", "low"),
    "open_close_diff": div("close - open", "open"),
    "high_low_diff": div("high - low", "low"),
    "price_volatility": roll("stddev_samp", "r", 20),
}
for n in W4:
    cols[f"price_rel_high_{n}"] = div("close", roll("max", "high", n))
    cols[f"price_rel_low_{n}"] = div("close", roll("min", "low", n))
add("price_features", lambda: [price.price()], with_(*HOURLY, f"x AS (SELECT *, {RET} AS r FROM bars_1h)") + pick(cols) + " FROM x")

# --- volume ------------------------------------------------------------------------------------
cols = {"volume_change_pct": f"{div('volume', lag('volume'))} - 1", "volume_oscillator": div(roll("avg", "volume", 5), roll("avg", "volume", 20))}
for n in W4:
    cols[f"rel_volume_{n}"] = div("volume", roll("avg", "volume", n))
for n in (10, 20):
    cols[f"price_volume_corr_{n}"] = (
        f"CASE WHEN {filled('close', n)} THEN "
        + div(trailing("covar_samp(close, volume)", n), f"{trailing('stddev_samp(close)', n)} * {trailing('stddev_samp(volume)', n)}")
        + " END"
    )
add("volume_features", lambda: [volume.volume()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

prev = f"x AS (SELECT *, {lag('close')} AS pc, {lag('volume')} AS pv FROM bars_1h)"
VWAP = div(cumulative(f"sum({TP} * volume)"), cumulative("sum(volume)"))
PVT = cumulative(f"sum(coalesce(({div('close', 'pc')} - 1) * volume, 0))")
OBV = cumulative("sum(CASE WHEN close < pc THEN -volume ELSE volume END)")
NVI = f"1000 * exp({cumulative('sum(CASE WHEN volume < pv THEN ln(close / pc) ELSE 0 END)')})"
add("vwap_pvt", lambda: [volume.cumulative(("vwap", "pvt"))], with_(*HOURLY, prev) + pick({"vwap": VWAP, "pvt": PVT}, 4) + " FROM x", digits=4)
add("obv", lambda: [volume.cumulative(("OBV",))], with_(*HOURLY, prev) + pick({"OBV": OBV}) + " FROM x")
def nvi_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute(bars(spark, sf_dir), volume.cumulative(("nvi",)))
    return rounded(out.select("symbol", "ts", F.ln("nvi").alias("ln_nvi")))


# The index spans many orders of magnitude, so its logarithm is compared.
QUERIES["nvi"] = nvi_log
SQL["nvi"] = with_(*HOURLY, prev) + pick({"ln_nvi": f"ln({NVI})"}) + " FROM x"

# --- volatility --------------------------------------------------------------------------------
GK = f"0.5 * pow(ln(high / low), 2) - {2 * math.log(2) - 1!r} * pow(ln(close / open), 2)"
x = f"x AS (SELECT *, {RET} AS r, {TR} AS tr, {GK} AS gk FROM bars_1h)"
cols = {"true_range": "tr", "garman_klass_vol": "gk"}
for n in W4:
    cols[f"returns_volatility_{n}"] = roll("stddev_samp", "r", n)
    cols[f"returns_range_{n}"] = f"{roll('max', 'r', n)} - {roll('min', 'r', n)}"
    cols[f"garman_klass_vol_{n}"] = roll("avg", "gk", n)
for n in (20, 50):
    cols[f"bollinger_width_{n}"] = div(f"4 * {roll('stddev_pop', 'close', n)}", roll("avg", "close", n)) + " * 100"
cols["keltner_width"] = div(f"{roll('avg', '(4 * high - 2 * low + close) / 3', 20)} - {roll('avg', '(-2 * high + 4 * low + close) / 3', 20)}", roll("avg", TP, 20))
cols = {k: f"({v})" for k, v in cols.items()}
add("volatility_features", lambda: [volatility.volatility()], with_(*HOURLY, x) + pick(cols) + " FROM x")

cols = {}
for n in (20, 50):
    mid, dev = roll("avg", "close", n), roll("stddev_pop", "close", n)
    cols |= {
        f"BBANDS_upper_{n}": f"{mid} + 2 * {dev}",
        f"BBANDS_middle_{n}": mid,
        f"BBANDS_lower_{n}": f"{mid} - 2 * {dev}",
        f"BBANDS_width_{n}": div(f"4 * {dev}", mid) + " * 100",
    }
add("bbands", lambda: [volatility.bbands()], with_(*HOURLY) + pick({k: f"({v})" for k, v in cols.items()}) + " FROM bars_1h")

chg = f"c AS (SELECT *, close - {lag('close')} AS d, {TR} AS tr FROM bars_1h)"
updn = "u AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM c)"
cols = {}
for n in (14, 20):
    mid, dev = roll("avg", "close", n), roll("stddev_samp", "close", n)
    weighted = " + ".join(f"{n - i} * {lag('close', i)}" if i else f"{n} * close" for i in range(n))
    cols |= {
        f"bbands_simple_upper_{n}": f"{mid} + 2 * {dev}",
        f"bbands_simple_lower_{n}": f"{mid} - 2 * {dev}",
        f"bbands_simple_width_{n}": div(f"2 * {dev}", mid),
        f"wma_{n}": f"({weighted}) / {n * (n + 1) / 2}",
        f"rsi_sma_{n}": div(f"100 * {roll('avg', 'up', n)}", f"{roll('avg', 'up', n)} + {roll('avg', 'dn', n)}"),
        f"atr_sma_{n}": roll("avg", "tr", n),
    }
add("simple_average_variants", lambda: [volatility.simple_variants()], with_(*HOURLY, chg, updn) + pick({k: f"({v})" for k, v in cols.items()}) + " FROM u")

# --- trend -------------------------------------------------------------------------------------
W6 = (5, 10, 20, 50, 100, 200)
cols = {}
for n in W6:
    cols[f"sma_{n}"] = roll("avg", "close", n)
    cols[f"price_rel_sma_{n}"] = div("close", roll("avg", "close", n))
add("sma_family", lambda: [trend.sma()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

EMA = lambda n, shown=None: (f"ema_{n}", "close", 2.0 / (n + 1), 1, n if shown is None else shown)
ema_cte = recur("e", "bars_1h", [EMA(n) for n in W6])
cols = {}
for n in W6:
    cols[f"ema_{n}"] = f"e.ema_{n}"
    cols[f"price_rel_ema_{n}"] = div("b.close", f"e.ema_{n}")
JOIN = " FROM bars_1h b LEFT JOIN e ON e.symbol = b.symbol AND e.ts = b.ts"
add("ema", lambda: [trend.ema_family()], with_(*HOURLY, *ema_cte, recursive=True) + pick(cols, keys="b.symbol, b.ts") + JOIN)

means = "m AS (SELECT symbol, ts, close, " + ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (5, 20, 50)) + " FROM bars_1h)"
cols = {f"{k}_{a}_{b}_ratio": div(f"{t}.{k}_{a}", f"{t}.{k}_{b}") for k, t in (("sma", "m"), ("ema", "e")) for a, b in ((5, 20), (20, 50))}
add(
    "ma_ratios",
    lambda: [trend.sma((5, 20, 50), relative=False), trend.ema_family((5, 20, 50), relative=False), trend.ma_ratios()],
    with_(*HOURLY, means, *recur("e", "bars_1h", [EMA(n) for n in (5, 20, 50)]), recursive=True)
    + pick(cols, keys="m.symbol, m.ts")
    + " FROM m LEFT JOIN e ON e.symbol = m.symbol AND e.ts = m.ts",
    keep=list(cols),
)

cols = {f"WMA_{n}": "(" + " + ".join(f"{n - i} * {lag('close', i)}" if i else f"{n} * close" for i in range(n)) + f") / {n * (n + 1) / 2}" for n in (5, 10, 20)}
add("wma", lambda: [trend.wma()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

mid = lambda n: f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2"
cols = {"ichimoku_conv": mid(9), "ichimoku_base": mid(26), "ichimoku_a": f"({mid(9)} + {mid(26)}) / 2", "ichimoku_b": mid(52)}
add("ichimoku", lambda: [trend.ichimoku()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

dm = f"""d0 AS (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS down, {TR} AS tr FROM bars_1h),
d AS (SELECT symbol, ts, CASE WHEN up IS NULL THEN NULL WHEN up > down AND up > 0 THEN up ELSE 0 END AS p,
  CASE WHEN up IS NULL THEN NULL WHEN down > up AND down > 0 THEN down ELSE 0 END AS m, CASE WHEN up IS NOT NULL THEN tr END AS tr FROM d0)"""
items = [(f"{c}{n}", c, 1.0 / n, n, n) for n in (14, 20) for c in ("p", "m", "tr")]
di = "i AS (SELECT symbol, ts, " + ", ".join(f"100 * {div(f'p{n}', f'tr{n}')} AS pos{n}, 100 * {div(f'm{n}', f'tr{n}')} AS neg{n}" for n in (14, 20)) + " FROM s)"
dx = "j AS (SELECT *, " + ", ".join(f"100 * {div(f'abs(pos{n} - neg{n})', f'pos{n} + neg{n}')} AS dx{n}" for n in (14, 20)) + " FROM i)"
cols = {}
for n in (14, 20):
    cols |= {f"adx_pos_{n}": f"j.pos{n}", f"adx_neg_{n}": f"j.neg{n}", f"adx_{n}": f"a.adx{n}"}
add(
    "adx",
    lambda: [trend.adx()],
    with_(*HOURLY, dm, *recur("s", "d", items), di, dx, *recur("a", "j", [(f"adx{n}", f"dx{n}", 1.0 / n, n, n) for n in (14, 20)]), recursive=True)
    + pick(cols, keys="b.symbol, b.ts")
    + " FROM bars_1h b LEFT JOIN j ON j.symbol = b.symbol AND j.ts = b.ts LEFT JOIN a ON a.symbol = b.symbol AND a.ts = b.ts",
)

# --- momentum ----------------------------------------------------------------------------------
cols = {f"price_change_{n}": f"{div('close', lag('close', n))} - 1" for n in (1, 5, 10, 20, 50, 100)}
add("price_change_steps", lambda: [momentum.price_change()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

cols = {f"roc_{n}": f"({div('close', lag('close', n))} - 1) * 100" for n in (10, 20, 50)}
cols |= {f"momentum_{n}": f"({div('close', lag('close', n))} - 1) * 100 * 100" for n in (10, 20)}
add("roc", lambda: [momentum.roc()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

rng = lambda n: f"({roll('max', 'high', n)}) - ({roll('min', 'low', n)})"
K = lambda n: "100 * " + div(f"close - ({roll('min', 'low', n)})", rng(n))
add(
    "stochastic",
    lambda: [momentum.stochastic(), momentum.stochastic(5, 3, ("STOCH_K_5", "STOCH_D_5"))],
    with_(*HOURLY, f"x AS (SELECT *, {K(14)} AS k14, {K(5)} AS k5 FROM bars_1h)")
    + pick({"stoch_k": "k14", "stoch_d": roll("avg", "k14", 3), "STOCH_K_5": "k5", "STOCH_D_5": roll("avg", "k5", 3)})
    + " FROM x",
)

cols = {f"williams_{n}": "-100 * " + div(f"({roll('max', 'high', n)}) - close", rng(n)) for n in (14, 20)}
add("williams", lambda: [momentum.williams()], with_(*HOURLY) + pick(cols) + " FROM bars_1h")

cols = {}
t = f"t AS (SELECT symbol, ts, {TP} AS tp FROM bars_1h)"
for n in (14, 20):
    mean = roll("avg", "tp", n)
    cols[f"cci_{n}"] = div(f"tp - m{n}", f"0.015 * (list_sum(list_transform(l{n}, lambda v: abs(v - m{n}))) / {n})")
m = "m AS (SELECT *, " + ", ".join(f"{roll('avg', 'tp', n)} AS m{n}, {trailing('list(tp)', n)} AS l{n}" for n in (14, 20)) + " FROM t)"
add("cci", lambda: [momentum.cci()], with_(*HOURLY, t, m) + pick(cols) + " FROM m")

x = f"x AS (SELECT symbol, ts, {TP} AS tp, {TP} * volume AS mf, lag({TP}) OVER (PARTITION BY symbol ORDER BY ts) AS ptp FROM bars_1h)"
y = "y AS (SELECT *, CASE WHEN tp > ptp THEN mf ELSE 0 END AS pos, CASE WHEN tp < ptp THEN mf ELSE 0 END AS neg FROM x)"
cols = {f"mfi_{n}": f"CASE WHEN {filled('mf', n)} THEN {div('100 * ' + trailing('sum(pos)', n), trailing('sum(pos)', n) + ' + ' + trailing('sum(neg)', n))} END" for n in (14, 20)}
add("mfi", lambda: [momentum.mfi()], with_(*HOURLY, x, y) + pick(cols) + " FROM y")

x = f"x AS (SELECT symbol, ts, close - least(low, {lag('close')}) AS bp, greatest(high, {lag('close')}) - least(low, {lag('close')}) AS tr FROM bars_1h)"
part = lambda n: div(trailing("sum(bp)", n), trailing("sum(tr)", n))
add("ultimate", lambda: [momentum.ultimate()], with_(*HOURLY, x) + pick({"ultimate_osc": f"CASE WHEN {filled('bp', 28)} THEN 100 * (4 * {part(7)} + 2 * {part(14)} + {part(28)}) / 7 END"}) + " FROM x")

items = [(f"{s}{n}", s, 1.0 / n, n, n) for n in (2, 6, 14, 20) for s in ("up", "dn")]
cols = {f"rsi_{n}": div(f"100 * e.up{n}", f"e.up{n} + e.dn{n}") for n in (2, 6, 14, 20)}
add("rsi", lambda: [momentum.rsi()], with_(*HOURLY, chg, updn, *recur("e", "u", items), recursive=True) + pick(cols, keys="b.symbol, b.ts") + JOIN)

items = [(f"atr_{n}", "tr", 1.0 / n, n, n) for n in (5, 10, 14, 20, 50)]
add(
    "atr",
    lambda: [volatility.atr()],
    with_(*HOURLY, chg, *recur("e", "c", items), recursive=True) + pick({i[0]: f"e.{i[0]}" for i in items}, keys="b.symbol, b.ts") + JOIN,
)

MACD_CTES = [
    *recur("f", "bars_1h", [("e12", "close", 2 / 13, 1, 12), ("e26", "close", 2 / 27, 1, 26)]),
    "l AS (SELECT symbol, ts, e12 - e26 AS line FROM f)",
    *recur("e", "l", [("sig", "line", 2 / 10, 1, 9)]),
]
MACD_JOIN = JOIN + " LEFT JOIN l ON l.symbol = b.symbol AND l.ts = b.ts"
add(
    "macd",
    lambda: [momentum.macd()],
    with_(*HOURLY, *MACD_CTES, recursive=True) + pick({"macd": "l.line", "macd_signal": "e.sig", "macd_diff": "l.line - e.sig"}, keys="b.symbol, b.ts") + MACD_JOIN,
)

pairs = {"tsi": (25, 13), "tsi_5": (5, 2), "tsi_10": (10, 5), "tsi_20": (20, 10)}
first = [(f"{n}_{s}", s, 2 / (r + 1), 1, 1) for n, (r, _) in pairs.items() for s in ("d", "ad")]
second = [(f"{n}_{s}2", f"{n}_{s}", 2 / (q + 1), 1, 1) for n, (_, q) in pairs.items() for s in ("d", "ad")]
add(
    "tsi",
    lambda: [momentum.tsi()],
    with_(*HOURLY, f"c AS (SELECT symbol, ts, close - {lag('close')} AS d, abs(close - {lag('close')}) AS ad FROM bars_1h)", *recur("f", "c", first), *recur("e", "f", second), recursive=True)
    + pick({n: "100 * " + div(f"e.{n}_d2", f"e.{n}_ad2") for n in pairs}, keys="b.symbol, b.ts")
    + JOIN,
)

# --- signals -----------------------------------------------------------------------------------
sig = f"""g AS (SELECT symbol, ts, {roll('avg', 'close', 5)} AS s5, {roll('avg', 'close', 20)} AS s20 FROM bars_1h),
h AS (SELECT *, {lag('s5')} AS p5, {lag('s20')} AS p20 FROM g)"""
rsi14 = recur("q", "u", [("up", "up", 1.0 / 14, 14, 14), ("dn", "dn", 1.0 / 14, 14, 14)])
add(
    "signals",
    lambda: [signals.sma_cross(), momentum.macd(), signals.macd_sign(), momentum.rsi((14,)), signals.rsi_zone()],
    with_(*HOURLY, chg, updn, sig, *rsi14, *MACD_CTES, recursive=True)
    + f"""SELECT h.symbol, h.ts,
  CAST(CASE WHEN s5 > s20 AND p5 <= p20 THEN 1 ELSE 0 END AS INTEGER) AS signal_sma_cross_5_20,
  CAST(coalesce(sign(l.line - e.sig), 0) AS INTEGER) AS signal_macd_hist_sign,
  CAST(CASE WHEN {div('100 * q.up', 'q.up + q.dn')} > 70 THEN 1 WHEN {div('100 * q.up', 'q.up + q.dn')} < 30 THEN -1 ELSE 0 END AS INTEGER) AS signal_rsi_ob_os
FROM h LEFT JOIN e ON e.symbol = h.symbol AND e.ts = h.ts LEFT JOIN l ON l.symbol = h.symbol AND l.ts = h.ts
LEFT JOIN q ON q.symbol = h.symbol AND q.ts = h.ts""",
    keep=["signal_sma_cross_5_20", "signal_macd_hist_sign", "signal_rsi_ob_os"],
)

# --- microstructure ----------------------------------------------------------------------------
QUOTED = (*HOURLY, QUOTES)
MIDP = "((bid + ask) / 2)"
cols = {
    "spread": "ask - bid",
    "relative_spread": div("ask - bid", MIDP) + " * 100",
    "mid_price": MIDP,
    "bid_ask_volume_ratio": div("bid_volume", "ask_volume"),
    "bid_ask_volume_imbalance": div("bid_volume - ask_volume", "bid_volume + ask_volume"),
}
add("quote_features", lambda: [micro.quote()], with_(*QUOTED) + pick(cols) + " FROM quotes_1h", source=quotes)

x = "x AS (SELECT *, volume * trade_direction AS f FROM quotes_1h)"
cols = {"order_flow_indicator": "f", "cumulative_order_flow": cumulative("sum(f)")}
for n in W4:
    cols[f"order_flow_{n}"] = roll("sum", "f", n)
    cols[f"normalized_order_flow_{n}"] = div(roll("sum", "f", n), roll("sum", "volume", n))
add("order_flow", lambda: [micro.order_flow()], with_(*QUOTED, x) + pick(cols) + " FROM x", source=quotes)

x = f"x AS (SELECT *, CAST(sign(close - {lag('close')}) AS DOUBLE) AS dir FROM bars_1h), y AS (SELECT *, volume * dir AS f FROM x)"
cols = {"inferred_direction": "dir", "inferred_order_flow": "f", "cumulative_inferred_flow": cumulative("sum(f)")}
for n in W4:
    cols[f"inferred_flow_{n}"] = roll("sum", "f", n)
    cols[f"norm_inferred_flow_{n}"] = div(roll("sum", "f", n), roll("sum", "volume", n))
add("inferred_flow", lambda: [micro.inferred_flow()], with_(*HOURLY, x) + pick(cols) + " FROM y")

x = f"x AS (SELECT *, abs({div(MIDP, lag(MIDP))} - 1) AS mv FROM quotes_1h)"
IMB = f"abs({div('bid_volume - ask_volume', 'bid_volume + ask_volume')})"
cols = {"mid_price_change": "mv"}
for n in W4:
    cols[f"amihud_ratio_{n}"] = roll("avg", div("mv", "volume"), n)
    cols[f"liquidity_ratio_{n}"] = roll("avg", div("volume", "ask - bid"), n)
    cols[f"market_depth_{n}"] = roll("avg", "bid_volume + ask_volume", n)
    cols[f"market_resiliency_{n}"] = roll("avg", div("mv", IMB), n)
add("liquidity", lambda: [micro.quote_liquidity()], with_(*QUOTED, x) + pick(cols) + " FROM x", source=quotes)

x = f"x AS (SELECT *, abs({RET}) AS mv FROM bars_1h)"
cols = {"abs_price_change": "mv"}
for n in W4:
    cols[f"simple_amihud_{n}"] = roll("avg", div("mv", "volume"), n)
    cols[f"range_liquidity_{n}"] = roll("avg", div("volume", "high - low"), n)
add("range_liquidity", lambda: [micro.range_liquidity()], with_(*HOURLY, x) + pick(cols) + " FROM x")

def auto(a: str, b: str, n: int) -> str:
    both = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
    span = f"{n - 2} PRECEDING AND CURRENT ROW"
    return div(over(f"covar_samp({both}, {b})", span), f"{over(f'stddev_samp({both})', span)} * {over(f'stddev_samp({b})', span)}")


def clustering_sql(windows: tuple[int, ...], ctes: tuple[str, ...], source: str) -> str:
    x = f"""x AS (SELECT symbol, ts, {RET} AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM {source}),
y AS (SELECT *, abs(r) AS a, r * r AS q, abs({lag('r')}) AS pa, {lag('r')} * {lag('r')} AS pq FROM x)"""
    cols = {"returns": "r", "abs_returns": "a"}
    for n in windows:
        cols[f"volatility_clustering_{n}"] = f"CASE WHEN pos >= {2 * n - 1} THEN {auto('a', 'pa', n)} END"
        cols[f"arch_effect_{n}"] = f"CASE WHEN {filled('q', n)} THEN {auto('q', 'pq', n)} END"
    return with_(*ctes, x) + pick(cols) + " FROM y"


def impact_sql(windows: tuple[int, ...], ctes: tuple[str, ...], source: str) -> str:
    cols = {"price_change": "r"}
    for n in windows:
        cols[f"price_impact_{n}"] = roll("avg", div("r", "volume"), n)
        span = f"{n} PRECEDING AND 1 PRECEDING"
        cols[f"price_impact_coef_{n}"] = f"CASE WHEN {over('count(r)', span)} = {n} THEN {over('covar_pop(r, volume)', span)} / nullif({over('var_pop(volume)', span)}, 0) END"
    return with_(*ctes, f"x AS (SELECT *, {RET} AS r FROM {source})") + pick(cols, 8) + " FROM x"


add("vol_clustering", lambda: [micro.volatility_clustering()], clustering_sql(W4, HOURLY, "bars_1h"))
add("price_impact", lambda: [micro.price_impact()], impact_sql(W4, HOURLY, "bars_1h"), digits=8)

# Windows of hundreds of rows, over bars of one minute.
LONG_WINDOWS, MINUTES = (100, 250, 1000), (TRADES, bars_sql("1m"))
minutes = lambda spark, d: bars(spark, d, "1m")
add("vol_clustering_of_long_windows", lambda: [micro.volatility_clustering(LONG_WINDOWS)], clustering_sql(LONG_WINDOWS, MINUTES, "bars_1m"), source=minutes)
add("price_impact_of_long_windows", lambda: [micro.price_impact(LONG_WINDOWS)], impact_sql(LONG_WINDOWS, MINUTES, "bars_1m"), digits=8, source=minutes)

"""Pieces of SQL shared by the oracle queries."""

from __future__ import annotations

TRADES = """trades AS (
  SELECT event_type AS symbol, ts, value AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS size, event_id, user_id
  FROM events)"""

STEP = {"1m": 60, "1h": 3600, "4h": 14400, "1d": 86400}


def floor_ts(ts: str, seconds: int) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch({ts}) / {seconds}) * {seconds} AS BIGINT)))"


def bars(timeframe: str) -> str:
    return f"""bars_{timeframe} AS (
  SELECT symbol, {floor_ts('ts', STEP[timeframe])} AS ts,
         first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, event_id) AS close, sum(size) AS volume
  FROM trades GROUP BY 1, 2)"""


QUOTES = f"""quotes_1h AS (
  SELECT b.*, b.low AS bid, b.high AS ask, s.bid_volume, s.ask_volume, CAST(sign(b.close - b.open) AS DOUBLE) AS trade_direction
  FROM bars_1h b JOIN (
    SELECT symbol, {floor_ts('ts', 3600)} AS ts,
           sum(CASE WHEN user_id % 2 = 0 THEN size ELSE 0 END) AS bid_volume,
           sum(CASE WHEN user_id % 2 <> 0 THEN size ELSE 0 END) AS ask_volume
    FROM trades GROUP BY 1, 2) s USING (symbol, ts))"""

ORDER = "PARTITION BY symbol ORDER BY ts"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


HOURLY = (TRADES, bars("1h"))


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def over(expr: str, rows: str = "") -> str:
    frame = f" ROWS BETWEEN {rows}" if rows else ""
    return f"{expr} OVER ({ORDER}{frame})"


def trailing(expr: str, n: int) -> str:
    return over(expr, f"{n - 1} PRECEDING AND CURRENT ROW")


def cumulative(expr: str) -> str:
    return over(expr, "UNBOUNDED PRECEDING AND CURRENT ROW")


def filled(x: str, n: int) -> str:
    return f"{trailing(f'count({x})', n)} = {n}"


def roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN {filled(x, n)} THEN {trailing(f'{fn}({x})', n)} END"


def lag(x: str, n: int = 1) -> str:
    return over(f"lag({x}, {n})")


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded value; the same nudge as on the Spark side decides exact halves."""
    return f"round(({expr}) + 1e-{digits + 3}, {digits})"


def pick(columns: dict[str, str], digits: int = 6, keys: str = "symbol, ts") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{rnd(e, digits)} AS {n}" for n, e in columns.items())


def recur(tag: str, base: str, items: list[tuple[str, str, float, int, int]]) -> list[str]:
    """CTEs for y = (1-alpha) y' + alpha x on each item's non-null values.

    Each item is (name, x, alpha, seed rows, rows until shown); the seed is the mean of the first
    seed rows. ``{tag}`` holds (symbol, ts, name columns...).
    """
    rows = " UNION ALL ".join(
        f"SELECT symbol, ts, '{n}' AS name, CAST({x} AS DOUBLE) AS x, CAST({a!r} AS DOUBLE) AS alpha, {s} AS seed, {m} AS shown FROM {base} WHERE ({x}) IS NOT NULL"
        for n, x, a, s, m in items
    )
    names = ", ".join(f"max(CASE WHEN r.name = '{n}' THEN r.y END) AS {n}" for n, *_ in items)
    return [
        f"{tag}_x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, name ORDER BY ts) AS k FROM ({rows}))",
        f"""{tag}_r AS (
  SELECT symbol, name, CAST(any_value(seed) AS BIGINT) AS k, avg(x) AS y FROM {tag}_x WHERE k <= seed GROUP BY symbol, name HAVING count(*) = any_value(seed)
  UNION ALL
  SELECT l.symbol, l.name, l.k, (1 - l.alpha) * r.y + l.alpha * l.x
  FROM {tag}_r r JOIN {tag}_x l ON l.symbol = r.symbol AND l.name = r.name AND l.k = r.k + 1)""",
        f"""{tag} AS (
  SELECT l.symbol, l.ts, {names}
  FROM {tag}_x l LEFT JOIN {tag}_r r ON r.symbol = l.symbol AND r.name = l.name AND r.k = l.k AND l.k >= l.shown
  GROUP BY l.symbol, l.ts)""",
    ]

"""Quote, order-flow, liquidity and price-impact columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import core
from tickloom.functions.core import Family, Long, correlation, div, filled, roll, slope
from tickloom.functions.volatility import returns
from tickloom.operators.series import POS

DEFAULT = (5, 10, 20, 50)


def quote() -> Family:
    a, b, av, bv = (F.col(c) for c in ("ask", "bid", "ask_volume", "bid_volume"))

    def first(w):
        mid = (a + b) / 2
        return {
            "spread": a - b,
            "relative_spread": div(a - b, mid) * 100,
            "mid_price": mid,
            "bid_ask_volume_ratio": div(bv, av),
            "bid_ask_volume_imbalance": div(bv - av, bv + av),
        }

    return Family(levels=(first,))


def quote_prices() -> Family:
    """The part of ``quote`` that needs no quote volumes."""
    full = quote().levels[0]
    return Family(levels=(lambda w: {k: v for k, v in full(w).items() if "volume" not in k},))


def _split(windows: tuple[int, ...]) -> tuple[list[int], list[int]]:
    return [n for n in windows if n < core.LONG_ROWS], [n for n in windows if n >= core.LONG_ROWS]


def _flow(source: str, names: tuple[str, str], windows: tuple[int, ...], first, reach: int, total: str) -> Family:
    """Sums of a signed volume and their share of all volume."""
    short, long = _split(windows)
    flow, share = names

    def second(w):
        return {
            **{f"{flow}_{n}": roll(F.sum, F.col(source), w, n) for n in short},
            **{f"_{flow}_v_{n}": roll(F.sum, F.col("volume"), w, n) for n in short},
        }

    return Family(
        levels=(first, second),
        back=max(windows) + reach,
        long=tuple(r for n in long for r in (Long(f"{flow}_{n}", "sum", source, n), Long(f"_{flow}_v_{n}", "sum", "volume", n))),
        totals={total: ("sum", F.col(source))},
        final=lambda: {f"{share}_{n}": div(F.col(f"{flow}_{n}"), F.col(f"_{flow}_v_{n}")) for n in windows},
        temp=tuple(f"_{flow}_v_{n}" for n in windows),
    )


def order_flow(windows: tuple[int, ...] = DEFAULT) -> Family:
    first = lambda w: {"order_flow_indicator": F.col("volume") * F.col("trade_direction")}
    return _flow("order_flow_indicator", ("order_flow", "normalized_order_flow"), windows, first, 0, "cumulative_order_flow")


def inferred_flow(windows: tuple[int, ...] = DEFAULT) -> Family:
    def first(w):
        direction = F.signum(F.col("close") - F.lag("close").over(w))
        return {"inferred_direction": direction, "inferred_order_flow": F.col("volume") * direction}

    return _flow("inferred_order_flow", ("inferred_flow", "norm_inferred_flow"), windows, first, 1, "cumulative_inferred_flow")


def _means(inputs: dict[str, str], windows: tuple[int, ...], levels: tuple, reach: int) -> Family:
    """Rolling means named ``{name}_{window}`` of temporary columns."""
    short, long = _split(windows)
    return Family(
        levels=(*levels, lambda w: {f"{name}_{n}": roll(F.avg, F.col(c), w, n) for name, c in inputs.items() for n in short}),
        back=max(windows) + reach,
        long=tuple(Long(f"{name}_{n}", "mean", c, n) for name, c in inputs.items() for n in long),
        temp=tuple(inputs.values()),
    )


def quote_liquidity(windows: tuple[int, ...] = DEFAULT) -> Family:
    a, b, av, bv, v = (F.col(c) for c in ("ask", "bid", "ask_volume", "bid_volume", "volume"))

    def first(w):
        mid = (a + b) / 2
        return {"mid_price_change": F.abs(div(mid, F.lag(mid).over(w)) - 1), "_liq_spread": div(v, a - b), "_depth": bv + av}

    def second(w):
        move = F.col("mid_price_change")
        return {"_amihud": div(move, v), "_resilient": div(move, F.abs(div(bv - av, bv + av)))}

    inputs = {"amihud_ratio": "_amihud", "liquidity_ratio": "_liq_spread", "market_depth": "_depth", "market_resiliency": "_resilient"}
    return _means(inputs, windows, (first, second), 1)


def range_liquidity(windows: tuple[int, ...] = DEFAULT) -> Family:
    """Liquidity from prices and volume alone."""
    v = F.col("volume")
    first = lambda w: {"abs_price_change": F.abs(returns(w)), "_range_liq": div(v, F.col("high") - F.col("low"))}
    second = lambda w: {"_plain_amihud": div(F.col("abs_price_change"), v)}
    return _means({"simple_amihud": "_plain_amihud", "range_liquidity": "_range_liq"}, windows, (first, second), 1)


def volatility_clustering(windows: tuple[int, ...] = DEFAULT) -> Family:
    """Lag-1 autocorrelation of absolute (clustering) and squared (arch) returns.

    The clustering value of a series starts at its 2w-th row, the arch value with w returns; a
    constant window gives NULL.
    """
    short, long = _split(windows)

    def first(w):
        return {"returns": returns(w), "_at": F.col(POS)}

    def second(w):
        r = F.col("returns")
        return {"abs_returns": F.abs(r), "_sq_returns": r * r}

    def third(w):
        return {"_abs_before": F.lag("abs_returns").over(w), "_sq_before": F.lag("_sq_returns").over(w)}

    def fourth(w):
        out = {}
        x, y = F.col("abs_returns"), F.col("_sq_returns")
        for n in short:
            pairs = w.rowsBetween(-(n - 2), 0)
            out[f"volatility_clustering_{n}"] = F.when(F.col("_at") >= 2 * n - 1, correlation(x, F.col("_abs_before"), pairs))
            out[f"arch_effect_{n}"] = F.when(filled(y, w, n), correlation(y, F.col("_sq_before"), pairs))
        return out

    requests = []
    for n in long:
        requests.append(Long(f"volatility_clustering_{n}", "corr", "abs_returns", n - 1, "_abs_before", ready=F.col("_at") >= 2 * n - 1))
        requests.append(Long(f"arch_effect_{n}", "corr", "_sq_returns", n - 1, "_sq_before"))
    return Family(
        levels=(first, second, third, fourth), back=max(windows) + 2, long=tuple(requests), temp=("_at", "_sq_returns", "_abs_before", "_sq_before")
    )


def price_impact(windows: tuple[int, ...] = DEFAULT) -> Family:
    """Mean return per volume, and the slope of return on volume over the rows before."""
    v = F.col("volume")
    short, long = _split(windows)
    first = lambda w: {"price_change": returns(w)}
    second = lambda w: {"_impact": div(F.col("price_change"), v)}

    def third(w):
        r = F.col("price_change")
        out = {}
        for n in short:
            out[f"price_impact_{n}"] = roll(F.avg, F.col("_impact"), w, n)
            before = w.rowsBetween(-n, -1)
            complete = F.count(F.when(r.isNotNull() & v.isNotNull(), 1)).over(before) == n
            out[f"price_impact_coef_{n}"] = F.when(complete, slope(r, v, before, F.lag(v).over(w)))
        return out

    requests = []
    for n in long:
        requests.append(Long(f"price_impact_{n}", "mean", "_impact", n))
        requests.append(Long(f"price_impact_coef_{n}", "slope", "volume", n, "price_change", end=-1))
    return Family(levels=(first, second, third), back=max(windows) + 1, long=tuple(requests), temp=("_impact",))

"""SQL for ridge fits on any subset of the feature matrix: sweeps of the scaled matrix of covariances, one step a column."""

from __future__ import annotations

from collections.abc import Sequence

from registry.analysis import X
from registry.sql import rnd

P = len(X)
NAMES = [*X, "y"]
ALL = (1 << P) - 1
METRIC_SQL = {
    "rmse": "sqrt(avg(pow(y - p, 2)))", "mae": "avg(abs(y - p))", "r2": "1 - avg(pow(y - p, 2)) / var_pop(y)",
    "direction_accuracy": "avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END)",
}


def mask_of(columns: Sequence[str]) -> int:
    return sum(1 << X.index(c) for c in columns)


def candidates(rows: Sequence[tuple[int, float, int]]) -> str:
    """ca (c number, lam penalty, mask of columns)."""
    return "ca AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, CAST({lam!r} AS DOUBLE), {mask})" for c, lam, mask in rows) + ") v(c, lam, mask))"


def fits(rows: str = "fo", tag: str = "", names: Sequence[str] = tuple(NAMES)) -> list[str]:
    """CTEs down to ``bi{tag}`` (k, c, a intercept, b0, b1, ...): fits of each candidate in ca on the training rows of each k in ``rows``.

    ``names`` are the columns and then the label.
    """
    p = len(names) - 1
    moments = [f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(names)]
    pairs = [f"covar_pop({names[i]}, {names[j]}) AS c{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)]
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': c{min(i, j)}_{max(i, j)} / (s{i} * s{j})}}" for i in range(p + 1) for j in range(p + 1))
    out = [
        f"mo{tag} AS MATERIALIZED (SELECT k, {', '.join(moments + pairs)} FROM {rows} WHERE role = 'train' GROUP BY k)",
        f"z0{tag} AS (SELECT k, c, mask, e.i AS i, e.j AS j, e.v + CASE WHEN e.i = e.j AND e.i < {p} THEN lam / s{p} ELSE 0 END AS v FROM (SELECT k, s{p}, unnest([{cells}]) AS e FROM mo{tag}), ca)",
    ]
    for t in range(p):
        out.append(
            f"""z{t + 1}{tag} AS MATERIALIZED (SELECT k, c, mask, i, j, CASE WHEN (mask >> {t}) & 1 = 0 THEN v WHEN i = {t} AND j = {t} THEN -1 / d WHEN i = {t} OR j = {t} THEN v / d ELSE v - vi * vj / d END AS v
  FROM (SELECT *, max(CASE WHEN i = {t} AND j = {t} THEN v END) OVER (PARTITION BY k, c) AS d, max(CASE WHEN j = {t} THEN v END) OVER (PARTITION BY k, c, i) AS vi,
    max(CASE WHEN i = {t} THEN v END) OVER (PARTITION BY k, c, j) AS vj FROM z{t}{tag}))"""
        )
    betas = ", ".join(f"sum(CASE WHEN i = {i} AND (mask >> {i}) & 1 = 1 THEN v * s{p} / s{i} ELSE 0 END) AS b{i}" for i in range(p))
    out.append(f"bb{tag} AS (SELECT k, c, mask, {betas} FROM z{p}{tag} JOIN mo{tag} USING (k) WHERE j = {p} AND i < {p} GROUP BY k, c, mask)")
    out.append(f"bi{tag} AS MATERIALIZED (SELECT bb{tag}.*, m{p} - (" + " + ".join(f"b{i} * m{i}" for i in range(p)) + f") AS a FROM bb{tag} JOIN mo{tag} USING (k))")
    return out


def fitted(tag: str = "", names: Sequence[str] = tuple(NAMES)) -> str:
    return "a + " + " + ".join(f"b{i} * {c}" for i, c in enumerate(names[:-1]))


def tested(rows: str = "fo", tag: str = "") -> str:
    """te (k, c, y, p prediction) of the test rows."""
    return f"te{tag} AS (SELECT k, c, y, {fitted(tag)} AS p FROM {rows} JOIN bi{tag} USING (k) WHERE role = 'test')"


def metric_rows(model: str, source: str = "te", digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{model}' AS model, CAST(k AS INTEGER) AS fold, '{m}' AS metric, {rnd(e, digits)} AS value FROM {source} GROUP BY k" for m, e in METRIC_SQL.items())


# Masks of the fits that an elimination meets on the training rows of each k, from all columns to one; ca must hold every mask as its c.
def eliminations(tag: str = "") -> list[str]:
    rank = sorted(range(P), key=lambda i: X[i], reverse=True)
    cells = ", ".join(f"{{'i': {i}, 'b': abs(b{i}), 'o': {rank.index(i)}}}" for i in range(P))
    return [
        f"co{tag} AS (SELECT k, c, unnest([{cells}]) AS e FROM bi{tag})",
        f"wk{tag} AS (SELECT k, c, i FROM (SELECT k, c, e.i AS i, row_number() OVER (PARTITION BY k, c ORDER BY e.b, e.o) AS w FROM co{tag} WHERE (c >> e.i) & 1 = 1) WHERE w = 1)",
        f"pa{tag} AS (SELECT k, CAST({ALL} AS INTEGER) AS c FROM mo{tag} UNION ALL SELECT pa{tag}.k, CAST(pa{tag}.c - (1 << i) AS INTEGER) FROM pa{tag} JOIN wk{tag} ON wk{tag}.k = pa{tag}.k AND wk{tag}.c = pa{tag}.c WHERE bit_count(pa{tag}.c) > 1)",
    ]


EVERY_SUBSET = candidates([(m, 0.0, m) for m in range(1, ALL + 1)])

"""Model, selection-by-model, dispatcher and whole-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import fits
from registry.analysis import FSCORE, MATRIX, PEARSON, X, matrix, predictions
from registry.common import rounded
from registry.features import TP, without_bar
from registry.sql import HOURLY, cumulative, div, lag, pick, recur, rnd, roll, with_
from tickloom.operators import split
from tickloom.operators.metrics import regression
from tickloom.operators.series import epoch_seconds
from tickloom.plans import analysis, features, models, selection
from tickloom.session import cut_lineage, shared_folder
from tickloom.sources.tables import bars, table
from tickloom.streaming.bars import replay_bars, stream_ema
from tickloom.streaming.upsert import read_latest, upsert_latest

QUERIES = {}
SQL = {}


def query(sql: str | None = None, digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, d: rounded(fn(spark, d), digits)
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def kept_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(matrix(spark, d))


def with_split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(split.chronological(matrix(spark, d)))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


# --- dispatcher and feature table --------------------------------------------------------------
names = ["SMA", "BBANDS", "STOCH", "ROC", "OBV", "MFI", "EMA", "RSI"]
cols = {}
for n in (5, 20):
    m, s = roll("avg", "b.close", n), roll("stddev_pop", "b.close", n)
    cols |= {f"SMA_{n}": m, f"BBANDS_upper_{n}": f"{m} + 2 * {s}", f"BBANDS_middle_{n}": m, f"BBANDS_lower_{n}": f"{m} - 2 * {s}", f"BBANDS_width_{n}": div(f"4 * {s}", m) + " * 100"}
    cols[f"ROC_{n}"] = f"({div('close', lag('close', n))} - 1) * 100"
    pos = f"sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    neg = pos.replace("tp > ptp", "tp < ptp")
    cols[f"MFI_{n}"] = f"CASE WHEN {roll('count', 'tp', n).split(' THEN ')[0][10:]} THEN {div('100 * ' + pos, pos + ' + ' + neg)} END"
    cols[f"EMA_{n}"] = f"ema{n}"
    cols[f"RSI_{n}"] = div(f"100 * up{n}", f"up{n} + dn{n}")
low, high = roll("min", "low", 5), roll("max", "high", 5)
cols["STOCH_K"] = "k"
cols["STOCH_D"] = roll("avg", "k", 3)
cols["OBV"] = cumulative("sum(CASE WHEN close < pc THEN -volume ELSE volume END)")
cols = {k: f"({v.replace('b.close', 'close')})" for k, v in cols.items()}
DISPATCH = with_(
    *HOURLY,
    f"u AS (SELECT *, {TP} AS tp, {lag('close')} AS pc, lag({TP}) OVER (PARTITION BY symbol ORDER BY ts) AS ptp, 100 * {div(f'close - ({low})', f'({high}) - ({low})')} AS k FROM bars_1h)",
    "v AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS dn FROM u)",
    *recur("e", "v", [(f"ema{n}", "close", 2.0 / (n + 1), 1, n) for n in (5, 20)] + [(f"{c}{n}", c, 1.0 / n, n, n) for n in (5, 20) for c in ("up", "dn")]),
    "j AS (SELECT v.*, e.* EXCLUDE (symbol, ts) FROM v LEFT JOIN e ON e.symbol = v.symbol AND e.ts = v.ts)",
    recursive=True,
)


@query(DISPATCH + pick(cols) + " FROM j")
def indicator_dispatch(spark, d):
    return without_bar(features.indicators(bars(spark, d), names, [5, 20]))


@query()
def feature_table(spark, d):
    return features.compute_features(bars(spark, d)).drop("timeframe")


# --- models ------------------------------------------------------------------------------------
@query(
    with_(*MATRIX)
    + f"SELECT 'hl' AS term, {rnd('regr_slope(y, hl)')} AS coefficient FROM m UNION ALL SELECT 'intercept', {rnd('regr_intercept(y, hl)')} FROM m"
)
def linear_fit(spark, d):
    return models.coefficients(spark, models.fit(kept_matrix(spark, d), ["hl"], "y", "linear"), ["hl"])


@query(
    with_(*HOURLY, f"a AS (SELECT symbol, close AS y, {lag('close')} AS x FROM bars_1h)", "b AS (SELECT * FROM a WHERE x IS NOT NULL)")
    + f"SELECT symbol, 'close_lag_1' AS term, {rnd('regr_slope(y, x)')} AS coefficient FROM b GROUP BY 1 UNION ALL SELECT symbol, 'intercept', {rnd('regr_intercept(y, x)')} FROM b GROUP BY 1"
)
def autoregression(spark, d):
    return models.autoregression(bars(spark, d), "close", 1)


LAGGED = ("x1", "x2", "x3", "y")


@query(
    with_(
        *HOURLY,
        "fo AS (SELECT * FROM (SELECT symbol AS k, 'train' AS role, close AS y, " + ", ".join(f"{lag('close', i)} AS x{i}" for i in (1, 2, 3)) + " FROM bars_1h) WHERE x3 IS NOT NULL)",
        fits.candidates([(0, 0.0, 7)]), *fits.fits("fo", "", LAGGED),
    )
    + " UNION ALL ".join(f"SELECT k AS symbol, '{t}' AS term, {rnd(e)} AS coefficient FROM bi" for t, e in (*((f"close_lag_{i}", f"b{i - 1}") for i in (1, 2, 3)), ("intercept", "a")))
)
def autoregression_order_3(spark, d):
    return models.autoregression(bars(spark, d), "close", 3)


def scored(kind: str, **params):
    def run(spark, d):
        train, test = with_split(spark, d)
        return models.predict(models.fit(train, X, "y", kind, **params), test).select("symbol", "ts", "y", "prediction")

    return run


for name, fn in {
    "ridge_fit": scored("ridge", regParam=0.1),
    "lasso_fit": scored("lasso", regParam=0.01),
    "elastic_net_fit": scored("elastic_net", regParam=0.01),
    "forest_fit": scored("forest", numTrees=10, maxDepth=4),
    "gbt_fit": scored("gbt", maxIter=5, maxDepth=3),
}.items():
    QUERIES[name] = lambda spark, d, fn=fn: rounded(fn(spark, d))


def classified(kind: str, **params):
    def run(spark, d):
        train, test = (part.withColumn("up", (F.col("y") > 0).cast("double")) for part in with_split(spark, d))
        out = models.predict(models.fit(train, X, "up", kind, **params), test)
        return out.select("symbol", "ts", "up", "prediction", *(["probability"] if "probability" in out.columns else []))

    return run


for name, fn in {
    "logistic_fit": classified("logistic", maxIter=20),
    "forest_classifier_fit": classified("forest_classifier", numTrees=10, maxDepth=4),
    "gbt_classifier_fit": classified("gbt_classifier", maxIter=5, maxDepth=3),
    "linear_svm_fit": classified("linear_svm", maxIter=10),
}.items():
    QUERIES[name] = lambda spark, d, fn=fn: rounded(fn(spark, d))


@query()
def gbt_early_stop(spark, d):
    rows = cut_lineage(split.chronological(matrix(spark, d)))
    train = rows.filter("split <> 'test'").withColumn("held_out", F.col("split") == "validation")
    model = models.fit_with_early_stop(train, X, "y", "held_out", maxIter=10, maxDepth=3)
    return models.predict(model, rows.filter("split = 'test'")).select("symbol", "ts", "y", "prediction")


KNN = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
n AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), t.vec_id) AS rn FROM e q, e t),
v AS (SELECT vec_id, label, count(*) AS c FROM n WHERE rn <= 5 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS o FROM v)"""


@query(f"WITH {KNN} SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM w WHERE o = 1")
def knn_classify(spark, d):
    e = table(spark, d, "embeddings")
    return models.knn(e, e, ["embedding"], "label", "vec_id", classify=True)


@query(f"WITH {KNN} SELECT vec_id, {rnd('avg(label)')} AS prediction FROM n WHERE rn <= 5 GROUP BY 1")
def knn_regress(spark, d):
    e = table(spark, d, "embeddings")
    return models.knn(e, e, ["embedding"], "label", "vec_id")


@query()
def pca_projection(spark, d):
    out, _ = models.pca(kept_matrix(spark, d), X, 2)
    # The sign of a component is arbitrary.
    return out.select("symbol", "ts", F.abs("pc_1").alias("pc_1"), F.abs("pc_2").alias("pc_2"))


@query()
def model_importance(spark, d):
    model = models.fit(kept_matrix(spark, d), X, "y", "forest", numTrees=10, maxDepth=4)
    return models.importance(spark, model, X)


# --- validation, stacking, search --------------------------------------------------------------
# One column has closed forms: the fit of each fold is its slope and intercept on the training rows.
RANKED = "po AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS i, count(*) OVER () AS n FROM m)"


def fold_metrics(roles: str, model: str) -> str:
    """SQL for the metrics by fold; ``roles`` defines fo with k, role, hl and y."""
    metrics = {"rmse": "sqrt(avg(pow(y - p, 2)))", "mae": "avg(abs(y - p))", "r2": "1 - avg(pow(y - p, 2)) / var_pop(y)", "direction_accuracy": "avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END)"}
    ctes = (*MATRIX, RANKED, roles, "fi AS (SELECT k, regr_slope(y, hl) AS s, regr_intercept(y, hl) AS b FROM fo WHERE role = 'train' GROUP BY k)", "te AS (SELECT fo.k, y, b + s * hl AS p FROM fo JOIN fi ON fi.k = fo.k WHERE role = 'test')")
    return with_(*ctes) + " UNION ALL ".join(f"SELECT '{model}' AS model, CAST(k AS INTEGER) AS fold, '{m}' AS metric, {rnd(e)} AS value FROM te GROUP BY k" for m, e in metrics.items())


TIME_ROLES = """fo AS (SELECT * FROM (SELECT *, CASE WHEN i >= start AND i < start + size THEN 'test' WHEN i < start - 5 THEN 'train' END AS role
  FROM (SELECT *, n // 4 AS size, n - (n // 4) * (3 - k) AS start FROM po, (SELECT unnest(range(0, 3)) AS k))) WHERE role IS NOT NULL)"""
TWO_FOLDS = TIME_ROLES.replace("start - 5", "start").replace("n // 4", "n // 3").replace("(3 - k)", "(2 - k)").replace("range(0, 3)", "range(0, 2)")
WALK_ROLES = """fo AS (SELECT * FROM (SELECT *, CASE WHEN i < start THEN 'train' WHEN i < start + size THEN 'test' END AS role
  FROM (SELECT *, greatest((n - n // 2) // 3, 1) AS size, n // 2 + greatest((n - n // 2) // 3, 1) * k AS start FROM po, (SELECT unnest(range(0, 3)) AS k))) WHERE role IS NOT NULL)"""
HASH_ROLES = """fo AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(concat_ws('|', symbol, CAST(ts AS VARCHAR), '42')), 1, 8) AS BIGINT) % 3 = k THEN 'test' ELSE 'train' END AS role
  FROM po, (SELECT unnest(range(0, 3)) AS k))"""


def folded_sql(roles: str, chosen: str, *more: str) -> str:
    """WITH of the feature matrix, the roles of its rows in each fold, candidates, their fits and predictions."""
    return with_(*MATRIX, RANKED, roles, chosen, *fits.fits(), fits.tested(), *more)


PLAIN = fits.candidates([(0, 0.0, fits.ALL)])


@query(folded_sql(TIME_ROLES, PLAIN) + fits.metric_rows("linear"))
def cross_validation(spark, d):
    return models.cross_validate(split.time_segments(matrix(spark, d), 3, gap=5), X, "y", "linear")


@query(folded_sql(HASH_ROLES, PLAIN) + fits.metric_rows("linear"))
def shuffled_cross_validation(spark, d):
    return models.cross_validate(split.hashed_segments(matrix(spark, d), 3), X, "y", "linear")


@query(folded_sql(WALK_ROLES, fits.candidates([(0, 0.1, fits.ALL)])) + fits.metric_rows("ridge"))
def walk_forward(spark, d):
    return models.cross_validate(split.walk_segments(matrix(spark, d), steps=3), X, "y", "ridge", regParam=0.1)


@query(fold_metrics(TIME_ROLES, "linear"))
def cross_validation_of_one_column(spark, d):
    return models.cross_validate(split.time_folds(matrix(spark, d), 3, gap=5), ["hl"], "y", "linear")


@query(fold_metrics(WALK_ROLES, "linear"))
def walk_forward_of_one_column(spark, d):
    return models.cross_validate(split.walk_forward(matrix(spark, d), steps=3), ["hl"], "y", "linear")


@query(fold_metrics(HASH_ROLES, "linear"))
def shuffled_validation_of_one_column(spark, d):
    return models.cross_validate(models.roles_from_fold(split.hashed_folds(matrix(spark, d), 3), 3), ["hl"], "y", "linear")


@query(f"SELECT CAST(1 AS INTEGER) AS features, metric, {rnd('avg(value)', 5)} AS mean, {rnd('stddev_pop(value)', 5)} AS std FROM ({fold_metrics(TIME_ROLES, 'linear')}) GROUP BY metric", digits=5)
def subset_curve_of_one_column(spark, d):
    return selection.subset_curve(split.time_folds(matrix(spark, d), 3, gap=5), ["hl"], "y", [1])


def planted(spark, d) -> DataFrame:
    """Every event with a label that is a step of one column; every fifth event is for testing."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", k.alias("k"), "value", (F.col("user_id") % 7).cast("double").alias("noise"), F.when(k < 50, 1.0).otherwise(3.0).alias("y"), (k >= 50).cast("double").alias("up"))


PLANTED = {
    "forest": {"numTrees": 10, "maxDepth": 4, "featureSubsetStrategy": "all"}, "gbt": {"maxIter": 5, "maxDepth": 3}, "linear": {}, "ridge": {"regParam": 0.01}, "lasso": {"regParam": 0.01}, "elastic_net": {"regParam": 0.01},
    "logistic": {"maxIter": 50}, "forest_classifier": {"numTrees": 10, "maxDepth": 4, "featureSubsetStrategy": "all"}, "gbt_classifier": {"maxIter": 5, "maxDepth": 3}, "linear_svm": {"maxIter": 50},
}
CLASSIFIERS = ("logistic", "forest_classifier", "gbt_classifier", "linear_svm")
PLANTED_COLUMNS = ["k", "value", "noise"]


@query(
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS rows, CAST(0 AS BIGINT) AS missing, TRUE AS close FROM events WHERE event_id % 5 = 0" for kind in PLANTED
    )
)
def models_on_a_planted_step(spark, d):
    """Every model scores every test row; trees find the step, linear models most of it."""
    rows = cut_lineage(planted(spark, d))
    train, test, out = rows.filter("event_id % 5 <> 0"), rows.filter("event_id % 5 = 0"), None
    for kind, params in PLANTED.items():
        label = "up" if kind in CLASSIFIERS else "y"
        scored = models.predict(models.fit(train, PLANTED_COLUMNS, label, kind, **params), test)
        wrong = F.avg((F.col("prediction") != F.col("up")).cast("double")) if kind in CLASSIFIERS else F.avg(F.pow(F.col("prediction") - F.col("y"), 2))
        bound = 0.05 if kind in CLASSIFIERS else 0.05 if kind in ("forest", "gbt") else 0.4
        part = scored.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count(F.when(F.col("prediction").isNull(), 1)).alias("missing"), (wrong < bound).alias("close"))
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, 'k' AS best" for m in ("importance", "permutation", "elimination", "elimination_with_folds")))
def selection_on_a_planted_step(spark, d):
    """Each method that refits models puts the column with the step first."""
    rows = cut_lineage(planted(spark, d).withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + event_id * INTERVAL '1' MINUTE")).withColumn("symbol", F.lit("x")))
    small = {"numTrees": 5, "maxDepth": 3, "featureSubsetStrategy": "all"}
    model = models.fit(rows, PLANTED_COLUMNS, "y", "forest", **small)
    best = lambda df: df.orderBy(F.col("score").desc(), "feature").first()["feature"]
    found = {
        "importance": best(models.importance(spark, model, PLANTED_COLUMNS)),
        "permutation": best(selection.permutation_importance(model, rows, PLANTED_COLUMNS, "y", repeats=2)),
        "elimination": best(selection.recursive_elimination(rows, PLANTED_COLUMNS, "y", 1, "forest", **small)),
        "elimination_with_folds": selection.elimination_with_folds(split.time_folds(rows, 2), PLANTED_COLUMNS, "y", "forest", **small)[0][0],
    }
    return spark.createDataFrame(list(found.items()), "method string, best string")


KINDS = {"ridge": ("ridge", {"regParam": 0.1}), "tree": ("forest", {"numTrees": 5, "maxDepth": 3})}


@query()
def stacking(spark, d):
    model, wide = models.stack(split.time_folds(matrix(spark, d), 3), X, "y", KINDS)
    return models.predict(model, wide).select("symbol", "ts", "label", "prediction")


# Each row is predicted by the fits of the fold that tests it; the second level is fitted on these predictions.
BASES = {"plain": ("linear", {}), "firm": ("ridge", {"regParam": 1.0})}
STACKED = (
    "s1 AS (SELECT symbol, ts, y, max(CASE WHEN c = 0 THEN p END) AS plain, max(CASE WHEN c = 1 THEN p END) AS firm FROM (SELECT symbol, ts, y, c, " + fits.fitted() + " AS p FROM fo JOIN bi USING (k) WHERE role = 'test') GROUP BY symbol, ts, y)",
    "s2 AS (SELECT *, 0 AS k, 'train' AS role FROM s1)",
)


def stacked_sql(penalty: float) -> str:
    """The second level's fit is candidate 2, which takes both columns."""
    chosen = fits.candidates([(0, 0.0, fits.ALL), (1, 1.0, fits.ALL), (2, penalty, 3)])
    return with_(*MATRIX, RANKED, TWO_FOLDS, chosen, *fits.fits(), *STACKED, *fits.fits("s2", "m", ("plain", "firm", "y")))


@query(stacked_sql(0.0) + f"SELECT symbol, ts, {rnd('y')} AS label, {rnd('a + b0 * plain + b1 * firm')} AS prediction FROM s2 JOIN bim USING (k) WHERE c = 2")
def linear_stacking(spark, d):
    model, wide = models.stack(split.time_segments(matrix(spark, d), 2), X, "y", BASES)
    return models.predict(model, wide).select("symbol", "ts", "label", "prediction")


@query(
    stacked_sql(1.0)
    + f"SELECT 'plain' AS model, {rnd('abs(b0) / (abs(b0) + abs(b1))')} AS weight FROM bim WHERE c = 2 UNION ALL SELECT 'firm', {rnd('abs(b1) / (abs(b0) + abs(b1))')} FROM bim WHERE c = 2"
)
def linear_stacking_weights(spark, d):
    _, wide = models.stack(split.time_segments(matrix(spark, d), 2), X, "y", BASES)
    return spark.createDataFrame(list(models.stacking_weights(wide, list(BASES)).items()), "model string, weight double")


@query()
def stacking_weights(spark, d):
    _, wide = models.stack(split.time_folds(matrix(spark, d), 3), X, "y", KINDS)
    return spark.createDataFrame(list(models.stacking_weights(wide, list(KINDS)).items()), "model string, weight double")


def result_table(spark, found):
    return spark.createDataFrame([(str(sorted(p.items())), v) for p, v in found], "params string, rmse double")


def search_sql(found: list[dict], *more: str) -> str:
    """sc (c, params, lam, mask, rmse) of ridge candidates."""
    chosen = fits.candidates([(i, c["regParam"], fits.mask_of(c.get("columns", X))) for i, c in enumerate(found)])
    named = "na AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, str(sorted(c.items())).replace("'", "''")) for i, c in enumerate(found)) + ") v(c, params))"
    means = "sc AS (SELECT c, params, lam, mask, avg(e) AS rmse FROM (SELECT k, c, sqrt(avg(pow(y - p, 2))) AS e FROM te GROUP BY k, c) JOIN na USING (c) JOIN ca USING (c) GROUP BY ALL)"
    return folded_sql(TWO_FOLDS, chosen, named, means, *more)


PENALTIES, SUBSETS = [0.01, 0.1, 1.0, 10.0], [X, X[:3], X[2:], ["r"], ["hl", "vc"]]
RIDGE_GRID = models.grid({"regParam": PENALTIES, "columns": SUBSETS})
DRAWN = models.random_grid({"regParam": [0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0], "columns": SUBSETS}, 7)


@query(search_sql(RIDGE_GRID) + f"SELECT params, {rnd('rmse')} AS rmse FROM sc")
def grid_search(spark, d):
    return result_table(spark, models.search(split.time_segments(matrix(spark, d), 2), X, "y", "ridge", RIDGE_GRID))


@query(search_sql(DRAWN) + f"SELECT params, {rnd('rmse')} AS rmse FROM sc")
def random_search(spark, d):
    return result_table(spark, models.search(split.time_segments(matrix(spark, d), 2), X, "y", "ridge", DRAWN))


@query(
    search_sql(RIDGE_GRID, f"fi AS (SELECT arg_min(lam, rmse) AS lam FROM sc WHERE mask = {fits.ALL})")
    + f"SELECT arg_min(params, rmse) AS params, {rnd('min(rmse)')} AS rmse FROM sc JOIN fi USING (lam)"
)
def staged_search(spark, d):
    """First the penalty on all columns, then the columns with that penalty."""
    stages = [{"regParam": PENALTIES}, {"columns": SUBSETS}]
    return result_table(spark, [models.staged_search(split.time_segments(matrix(spark, d), 2), X, "y", "ridge", stages)])


@query()
def elastic_net_search(spark, d):
    return result_table(spark, models.search(split.time_segments(matrix(spark, d), 2), X, "y", "elastic_net", models.grid({"regParam": [0.01, 0.1], "elasticNetParam": [0.2, 0.8]})))


@query()
def forest_search(spark, d):
    return result_table(spark, models.search(split.time_segments(matrix(spark, d), 2), X, "y", "forest", models.grid({"maxDepth": [2, 4], "numTrees": [5]})))


@query()
def permutation_importance(spark, d):
    rows = kept_matrix(spark, d)
    model = models.fit(rows, X, "y", "forest", numTrees=5, maxDepth=4)
    return selection.permutation_importance(model, rows, X, "y", repeats=2)


def dealt_sql(seed: int) -> str:
    """SQL for one step of the bijection of positions x in the base ``w``."""
    left, right = "x // w", "x % w"
    for a, b in selection.round_keys(seed):
        drawn = f"((({right}) * {a} + {b}) % {selection.PRIME})"
        left, right = right, f"(({left}) + {drawn} * {drawn} % {selection.PRIME}) % w"
    return f"({left}) * w + {right}"


ONE_FOLD = "fo AS (SELECT *, 0 AS k, 'train' AS role FROM po)"
REPEATS = 3
STEP = "CASE rep " + " ".join(f"WHEN {r} THEN {dealt_sql(42 + r)}" for r in range(REPEATS)) + " END"


@query(
    with_(
        *MATRIX, RANKED, ONE_FOLD, PLAIN, *fits.fits(),
        "wi AS (SELECT max(n) AS n, CAST(ceil(sqrt(max(n))) AS BIGINT) AS w FROM po)",
        f"dw AS (SELECT i, rep, {STEP} AS x FROM (SELECT i, i AS x, rep FROM (SELECT i FROM po), (SELECT unnest(range(0, {REPEATS})) AS rep)), wi UNION ALL SELECT i, rep, {STEP} FROM dw, wi WHERE x >= wi.n)",
        "dd AS (SELECT i, rep, x FROM dw, wi WHERE x < n)",
        f"pp AS (SELECT po.*, {fits.fitted()} AS p, " + ", ".join(f"b{j}" for j in range(len(X))) + " FROM po, bi)",
        "ri AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, dd.rep, avg(pow(o.y - (o.p + o.b{j} * (q.{c} - o.{c})), 2)) - avg(pow(o.y - o.p, 2)) AS rise FROM dd JOIN pp o ON o.i = dd.i JOIN pp q ON q.i = dd.x GROUP BY dd.rep" for j, c in enumerate(X)) + ")",
        recursive=True,
    )
    + f"SELECT feature, 'permutation' AS method, {rnd('avg(rise)')} AS score, {rnd('stddev_pop(rise)')} AS spread FROM ri GROUP BY feature"
)
def permutation_of_a_linear_model(spark, d):
    rows = kept_matrix(spark, d)
    return selection.permutation_importance(models.fit(rows, X, "y", "linear"), rows, X, "y", repeats=REPEATS)


@query()
def recursive_elimination(spark, d):
    return selection.recursive_elimination(matrix(spark, d), X, "y", 2, "forest", numTrees=5, maxDepth=3)


HALVES = "fo AS (SELECT *, 0 AS k, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'none' ELSE 'test' END AS role FROM po)"
SCORED = f"SELECT symbol, ts, {rnd('y')} AS y, {rnd(fits.fitted())} AS prediction FROM fo JOIN bi USING (k) WHERE role = 'test'"


SQL["ridge_fit"] = folded_sql(HALVES, fits.candidates([(0, 0.1, fits.ALL)])) + SCORED


@query(folded_sql(HALVES, PLAIN) + SCORED)
def saved_model(spark, d):
    """A fitted model is written, read again with its columns and used."""
    train, test = with_split(spark, d)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    models.save(models.fit(train, X, "y", "linear"), folder, X, kind="linear")
    model, about = models.load(spark, folder)
    return models.predict(model, test.select("symbol", "ts", "y", *about["features"])).select("symbol", "ts", "y", "prediction")


@query(folded_sql(HALVES.replace("'none'", "'train'"), PLAIN) + SCORED)
def updated_model(spark, d):
    """The model fitted again once the validation rows have come."""
    rows = cut_lineage(split.chronological(matrix(spark, d)))
    model = models.update(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), X, "y", "linear")
    return models.predict(model, rows.filter("split = 'test'")).select("symbol", "ts", "y", "prediction")


# Best F score first; a column goes if one taken before is correlated with it.
LIMIT = 0.02
CHOSEN = (
    f"cr AS ({PEARSON})",
    f"nb AS (SELECT feature, list(other) AS near FROM (SELECT a AS feature, b AS other FROM cr WHERE abs(r) > {LIMIT} UNION ALL SELECT b, a FROM cr WHERE abs(r) > {LIMIT}) GROUP BY feature)",
    f"fs AS (SELECT f.feature, coalesce(near, []) AS near, row_number() OVER (ORDER BY score DESC, f.feature) AS o FROM ({FSCORE}) f LEFT JOIN nb USING (feature))",
    "tk AS (SELECT CAST(0 AS BIGINT) AS o, CAST([] AS VARCHAR[]) AS taken UNION ALL SELECT fs.o, CASE WHEN list_has_any(taken, near) THEN taken ELSE list_append(taken, feature) END FROM tk JOIN fs ON fs.o = tk.o + 1)",
    "se AS (SELECT unnest(taken) AS feature, unnest(range(1, len(taken) + 1)) AS rank FROM (SELECT arg_max(taken, o) AS taken FROM tk))",
)


@query(with_(*MATRIX, *CHOSEN, recursive=True) + "SELECT CAST(rank AS INTEGER) AS rank, feature FROM se")
def analysis_selected(spark, d):
    """What an analysis run writes as its selection."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    analysis.run(matrix(spark, d), X, "y", folder, threshold=LIMIT)
    return spark.read.parquet(f"{folder}/selected")


@query(with_(*MATRIX, *CHOSEN, recursive=True) + f"SELECT symbol, ts, feature, {rnd('value')} AS value, {rnd('y')} AS y FROM (UNPIVOT m ON {', '.join(X)} INTO NAME feature VALUE value) SEMI JOIN se USING (feature)")
def selected_dataset(spark, d):
    """The table of the selected columns and the label, written and read again."""
    rows = cut_lineage(matrix(spark, d).withColumn("timeframe", F.lit("1h")))
    chosen = [r["feature"] for r in analysis.analyse(rows, X, "y", threshold=LIMIT)["selected"].orderBy("rank").collect()]
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    analysis.write_selected(rows, chosen, folder, ["y"])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in chosen])).alias("e")
    return spark.read.parquet(folder).select("symbol", "ts", "y", cells).select("symbol", "ts", "e.feature", "e.value", "y")


def curve_sql(source: str) -> str:
    """Mean and spread over the folds of each metric by number of columns; ``source`` has k, features, y and p."""
    parts = " UNION ALL ".join(f"SELECT features, k, '{m}' AS metric, {e} AS value FROM {source} GROUP BY features, k" for m, e in fits.METRIC_SQL.items())
    return f"SELECT CAST(features AS INTEGER) AS features, metric, {rnd('avg(value)', 5)} AS mean, {rnd('stddev_pop(value)', 5)} AS std FROM ({parts}) GROUP BY features, metric"


@query(folded_sql(TWO_FOLDS, fits.candidates([(k, 0.0, fits.mask_of(X[:k])) for k in (1, 3, 5)]), "fe AS (SELECT c AS features, k, y, p FROM te)") + curve_sql("fe"), digits=5)
def subset_curve(spark, d):
    return selection.subset_curve(split.time_segments(matrix(spark, d), 2), X, "y", [1, 3, 5])


@query(
    folded_sql(HALVES, fits.EVERY_SUBSET, *fits.eliminations()).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT count(*) AS rows, {rnd('avg(pow(y - p, 2))')} AS mse, "
    + ", ".join(f"{rnd(e)} AS {m}" for m, e in fits.METRIC_SQL.items())
    + ", CAST(3 AS INTEGER) AS features FROM te JOIN pa USING (k, c) WHERE bit_count(c) = 3"
)
def retrain_selected(spark, d):
    """A linear model on the three columns that an elimination on the training rows leaves."""
    train, test = with_split(spark, d)
    ranks = selection.recursive_elimination(train, X, "y", 3, "linear")
    chosen = [r["feature"] for r in ranks.filter("rank = 1").collect()]
    return selection.retrain_selected(train, test, chosen, "y", "linear")[1]


@query(
    with_(*HOURLY, f"r AS (SELECT symbol, ts, {div('close', lag('close'))} - 1 AS label FROM bars_1h)", f"p AS (SELECT *, {lag('label')} AS prediction FROM r)")
    + f"SELECT symbol, count(*) AS rows, {rnd('avg(abs(label - prediction))')} AS mae FROM p WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY 1"
)
def evaluate_ignoring_invalid(spark, d):
    return regression(predictions(spark, d).filter("model = 'last'"), by=["symbol"]).select("symbol", "rows", "mae")


@query(
    folded_sql(TWO_FOLDS, fits.EVERY_SUBSET, *fits.eliminations(), "fe AS (SELECT bit_count(c) AS features, k, y, p FROM te JOIN pa USING (k, c))").replace("WITH ", "WITH RECURSIVE ", 1) + curve_sql("fe"),
    digits=5,
)
def elimination_curve(spark, d):
    return selection.elimination_with_folds(split.time_segments(matrix(spark, d), 2), X, "y", "linear")[1]


# --- streaming ---------------------------------------------------------------------------------
@query(
    with_(*HOURLY)
    + pick({c: c for c in ("open", "high", "low", "close", "volume")})
    + " FROM bars_1h WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
)
def stream_bars(spark, d):
    """Bars the stream has closed once every event was read."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    ticks = events.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"), "event_id"
    )
    out = replay_bars(ticks, "1h", f"{shared_folder(spark)}/{uuid.uuid4().hex}", ties=["event_id"])
    return out.drop("timeframe")


#: Rows that a file of a stream holds at most, about, and files from which on a batch takes several.
FILE_ROWS = 2_000_000
FILES_ONE_BY_ONE = 100


def event_batches(spark, d, columns: str, repeated: bool = False) -> DataFrame:
    """All events as a stream of files of eight days, in which an event comes up to a day after its time.

    Rows named "end", far ahead, come last and let the watermark pass all others. With ``repeated`` every eleventh event comes twice.
    Eight days are one file, of many rows several. A batch is one file, of 100 files or more as many as leave about 100 batches.
    """
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    days, folder = f"{base}/days", f"{base}/files"
    events = table(spark, d, "events")
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(86400))
    rows = events.withColumn("_b", F.floor((epoch_seconds("ts") + jitter) / (8 * 86400))).selectExpr("event_id", "_b", *columns.split(", "))
    rows.hint("rebalance", F.col("_b")).write.partitionBy("_b").parquet(days)
    end = events.agg(F.expr("max(ts) + INTERVAL '100' DAY").alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")).selectExpr(*columns.split(", "))
    counts = spark.read.schema(rows.schema).parquet(days).groupBy("_b").count().collect()
    written = 1
    for b, n in sorted((r["_b"], r["count"]) for r in counts):
        part = spark.read.schema(rows.drop("_b").schema).parquet(f"{days}/_b={b}")
        if repeated:
            part = part.unionAll(part.filter("event_id % 11 = 0"))
        files = -(-n // FILE_ROWS)
        part = part.repartition(files) if files > 1 else part.coalesce(1)
        part.drop("event_id").write.mode("append").parquet(folder)
        written += files
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1 + written // FILES_ONE_BY_ONE).parquet(folder)


def run_through(started):
    run = started.trigger(availableNow=True).start()
    run.awaitTermination()
    return run


@query(
    with_(*HOURLY)
    + f"SELECT symbol, ts, {rnd('close')} AS close, 0.0::DOUBLE AS volume FROM bars_1h"
)
def stream_upsert(spark, d):
    """Events as price snapshots in several batches, late and some repeated; per series and hour the newest one stays."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    snapshots = event_batches(spark, d, "event_type AS symbol, ts, value AS last_price", repeated=True)
    run_through(upsert_latest(snapshots, "1h", f"{folder}/table", f"{folder}/state", late="20 days"))
    return read_latest(spark, f"{folder}/table").filter("symbol <> 'end'").select("symbol", "ts", "close", "volume")


@query(
    with_("t AS (SELECT event_type AS symbol, ts, value AS x FROM events)", *recur("e", "t", [("ema_9", "x", 0.2, 1, 1)]), recursive=True)
    + pick({"ema_9": "e.ema_9"}, keys="e.symbol, e.ts")
    + " FROM e"
)
def stream_average(spark, d):
    """A running average of each event type over rows that come out of order in several batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out = stream_ema(event_batches(spark, d, "event_type AS symbol, ts, value AS close"), {"ema_9": 9}, late="20 days")
    run_through(out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append"))
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").filter("symbol <> 'end'").select("symbol", "ts", "ema_9")

"""Selection, split, metric, blend and strategy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import rounded
from registry.sql import HOURLY, div, lag, over, pick, recur, rnd, roll, trailing, with_
from tickloom.operators import blend, metrics, select, split, strategy
from tickloom.operators.series import rolling, trailing as last_rows
from tickloom.session import cut_lineage
from tickloom.sources.tables import bars, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None, digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, d: rounded(fn(spark, d), digits)
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- feature matrix ----------------------------------------------------------------------------
X = ["r", "hl", "oc", "rv", "vc"]


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """Five features and the next bar's change; incomplete rows left out."""
    c, o, h, l, v = (F.col(n) for n in ("close", "open", "high", "low", "volume"))

    def level(w):
        mean5 = F.when(F.count(v).over(last_rows(w, 5)) == 5, F.avg(v).over(last_rows(w, 5)))
        return {
            "r": F.try_divide(c, F.lag(c).over(w)) - 1,
            "hl": F.try_divide(h - l, l),
            "oc": F.try_divide(c - o, o),
            "rv": F.try_divide(v, mean5),
            "vc": F.try_divide(v, F.lag(v).over(w)) - 1,
            "y": F.try_divide(F.lead(c).over(w), c) - 1,
        }

    return rolling(bars(spark, d), [level], back=5, ahead=1).select("symbol", "ts", *X, "y").dropna()


MATRIX = (
    *HOURLY,
    f"""m0 AS (SELECT symbol, ts, {div('close', lag('close'))} - 1 AS r, {div('high - low', 'low')} AS hl, {div('close - open', 'open')} AS oc,
  {div('volume', roll('avg', 'volume', 5))} AS rv, {div('volume', lag('volume'))} - 1 AS vc, {div(over('lead(close)'), 'close')} - 1 AS y FROM bars_1h)""",
    "m AS (SELECT * FROM m0 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in [*X, "y"]) + ")",
)
PAIRS = [(a, b) for i, a in enumerate(X) for b in X[i + 1 :]]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


PEARSON = union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM m" for a, b in PAIRS)


@query(with_(*MATRIX, f"c AS ({PEARSON})") + pick({"r": "r"}, keys="a, b") + " FROM c")
def corr_matrix(spark, d):
    return select.correlations(matrix(spark, d), X)


@query(with_(*MATRIX, f"c AS ({PEARSON})") + pick({"r": "r"}, keys="a, b") + " FROM c WHERE abs(r) > 0.02")
def corr_pairs(spark, d):
    return select.strong_pairs(select.correlations(matrix(spark, d), X), 0.02)


RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in X) + " FROM m)"


@query(with_(*MATRIX, RANKS) + union(f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})')} AS r FROM rk" for a, b in PAIRS))
def spearman_matrix(spark, d):
    return select.correlations(matrix(spark, d), X, "spearman")


@query(
    with_(
        *HOURLY,
        "k AS (SELECT volume AS x, round(close) AS y, row_number() OVER () AS i FROM bars_1h)",
        "n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM k)",
        "tx AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM k GROUP BY x))",
        "ty AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM k GROUP BY y))",
        "s AS (SELECT CAST(sum(sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) AS s FROM k a JOIN k b ON a.i < b.i)",
    )
    + f"SELECT 'x' AS a, 'y' AS b, {rnd('s.s / sqrt((n0 - tx.t) * (n0 - ty.t))')} AS r FROM s, n, tx, ty"
)
def kendall_pair(spark, d):
    # Volume and the whole-number close repeat, which exercises the tie terms.
    return select.kendall(bars(spark, d).select(F.col("volume").alias("x"), F.round("close").alias("y")), "x", "y")


# Columns cut to steps repeat values; the sums are taken over pairs of counted rows.
STEPPED = "kr AS (SELECT " + ", ".join(f"floor({c} * 50) AS {c}" for c in X) + ", row_number() OVER () AS i FROM m)"


def tau_sql(a: str, b: str) -> str:
    tied = lambda by: f"(SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM kr GROUP BY {by}))"
    score = f"(SELECT CAST(sum(sign(o.{a} - q.{a}) * sign(o.{b} - q.{b})) AS DOUBLE) FROM kr o JOIN kr q ON o.i < q.i)"
    pairs = "(SELECT count(*) * (count(*) - 1) / 2.0 FROM kr)"
    return f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'{score} / sqrt(({pairs} - {tied(a)}) * ({pairs} - {tied(b)}))')} AS r"


@query(with_(*MATRIX, STEPPED) + union(tau_sql(a, b) for a, b in PAIRS))
def kendall_matrix(spark, d):
    return select.kendall_matrix(matrix(spark, d).select(*[F.floor(F.col(c) * 50).alias(c) for c in X]), X)


@query(
    with_(*MATRIX, f"c AS ({PEARSON})", "l AS (SELECT a, b FROM c WHERE abs(r) > 0.02 UNION SELECT b, a FROM c WHERE abs(r) > 0.02)",
          "t AS (SELECT a AS feature, a AS g FROM l UNION SELECT l.b, t.g FROM t JOIN l ON l.a = t.feature)", recursive=True)
    + 'SELECT feature, min(g) AS "group" FROM t GROUP BY 1'
)
def correlated_groups(spark, d):
    return select.correlated_groups(select.correlations(matrix(spark, d), X), 0.02)


@query(with_(*MATRIX) + union(f"SELECT '{c}' AS feature, {rnd(f'corr({c}, y)')} AS r FROM m" for c in X))
def target_corr(spark, d):
    return select.target_correlations(matrix(spark, d), X, "y")


FSCORE = union(f"SELECT '{c}' AS feature, 'f_regression' AS method, pow(corr({c}, y), 2) / (1 - pow(corr({c}, y), 2)) * (count(*) - 2) AS score FROM m" for c in X)


@query(with_(*MATRIX, f"f AS ({FSCORE})") + pick({"score": "score"}, keys="feature, method") + " FROM f")
def f_regression_scores(spark, d):
    return select.f_scores(matrix(spark, d), X, "y")


def edge_list(c: str) -> str:
    return "list_value(" + ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10)) + ")"


MI = (
    "ed AS (SELECT " + ", ".join(f"{edge_list(c)} AS e_{c}" for c in [*X, "y"]) + " FROM m)",
    "bn AS (SELECT " + ", ".join(f"len(list_filter(e_{c}, lambda e: e < {c})) AS {c}" for c in [*X, "y"]) + " FROM m, ed)",
    "lg AS (" + union(f"SELECT '{c}' AS feature, {c} AS bx, y AS yb FROM bn" for c in X) + ")",
    "jn AS (SELECT feature, bx, yb, CAST(count(*) AS DOUBLE) AS n FROM lg GROUP BY 1, 2, 3)",
    "pj AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, yb) AS ny FROM jn)",
    "mi AS (SELECT feature, 'mutual_info' AS method, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS score FROM pj GROUP BY 1)",
)


@query(with_(*MATRIX, *MI) + pick({"score": "score"}, keys="feature, method") + " FROM mi")
def mi_scores(spark, d):
    return select.mutual_information(cut_lineage(matrix(spark, d)), X, "y")


def scores(spark, d):
    m = cut_lineage(matrix(spark, d))
    absolute = select.target_correlations(m, X, "y").select("feature", F.lit("abs_corr").alias("method"), F.abs("r").alias("score"))
    return select.f_scores(m, X, "y").unionByName(select.mutual_information(m, X, "y")).unionByName(absolute)


SCORES = (
    *MATRIX,
    *MI,
    f"sc AS ({FSCORE} UNION ALL SELECT feature, method, score FROM mi UNION ALL " + union(f"SELECT '{c}' AS feature, 'abs_corr' AS method, abs(corr({c}, y)) AS score FROM m" for c in X) + ")",
    "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS INTEGER) AS rank FROM sc)",
)


@query(with_(*SCORES) + pick({"score": "score"}, keys="method, feature, rank") + " FROM rk WHERE rank <= 3")
def topk_importance(spark, d):
    return select.top_k(scores(spark, d), 3)


@query(with_(*SCORES) + pick({"score": "score"}, keys="method, feature, rank") + " FROM rk WHERE (score >= 0.05 OR rank <= 2) AND rank <= 4")
def threshold_importance(spark, d):
    return select.above_threshold(scores(spark, d), 0.05, 2, 4)


CUM = "cu AS (SELECT *, score / sum(score) OVER (PARTITION BY method) AS share, sum(score) OVER (PARTITION BY method ORDER BY rank) / sum(score) OVER (PARTITION BY method) AS cumulative FROM rk)"


@query(with_(*SCORES, CUM) + pick({"score": "score", "share": "share", "cumulative": "cumulative"}, keys="method, feature, rank") + " FROM cu WHERE cumulative - share < 0.9")
def topk_cumulative_importance(spark, d):
    return select.cumulative_share(scores(spark, d), 0.9)


@query(with_(*SCORES) + f"SELECT feature, count(DISTINCT method) AS methods, {rnd('avg(score)')} AS score FROM rk WHERE rank <= 3 GROUP BY 1 HAVING count(DISTINCT method) >= 2")
def consensus_features(spark, d):
    return select.consensus(select.top_k(scores(spark, d), 3), 2)


@query(
    with_(*SCORES, "st AS (SELECT method, list(feature) AS f FROM rk WHERE rank <= 3 GROUP BY 1)")
    + f"SELECT a.method AS a, b.method AS b, len(list_intersect(a.f, b.f)) AS common, {rnd('len(list_intersect(a.f, b.f)) / CAST(len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)) AS DOUBLE)')} AS jaccard FROM st a JOIN st b ON a.method < b.method"
)
def jaccard_methods(spark, d):
    return select.overlap(select.top_k(scores(spark, d), 3))


@query(with_(*SCORES) + f"SELECT feature, {rnd('avg(score)')} AS score FROM rk GROUP BY 1")
def mean_importance(spark, d):
    return select.mean_importance(scores(spark, d))


@query(
    with_(*SCORES, "w AS (SELECT feature, sum(score * CASE method WHEN 'f_regression' THEN 0.2 WHEN 'mutual_info' THEN 0.5 ELSE 0.3 END) AS s FROM rk GROUP BY 1)")
    + pick({"score": "s / sum(s) OVER ()"}, keys="feature") + " FROM w"
)
def blend_importance(spark, d):
    return select.blend_importance(scores(spark, d), {"f_regression": 0.2, "mutual_info": 0.5, "abs_corr": 0.3})


# --- splits ------------------------------------------------------------------------------------
POS = "po AS (SELECT symbol, ts, row_number() OVER (ORDER BY ts, symbol) - 1 AS i, count(*) OVER () AS n FROM bars_1h)"


@query(with_(*HOURLY, POS) + f"SELECT symbol, ts, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * {0.7 + 0.15!r}::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM po")
def chrono_split(spark, d):
    return split.chronological(bars(spark, d)).select("symbol", "ts", "split")


@query(
    with_(*HOURLY, POS, "fo AS (SELECT *, n // 6 AS size, n - (n // 6) * (5 - k) AS start FROM po, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS k))")
    + "SELECT symbol, ts, k AS fold, CASE WHEN i >= start AND i < start + size THEN 'test' ELSE 'train' END AS role FROM fo WHERE (i >= start AND i < start + size) OR i < start - 10"
)
def ts_folds(spark, d):
    return split.time_folds(bars(spark, d), 5, gap=10).select("symbol", "ts", "fold", "role")


@query(
    with_(*HOURLY, POS, "fo AS (SELECT *, greatest((n - n // 2) // 5, 1) AS size, n // 2 + greatest((n - n // 2) // 5, 1) * k AS start FROM po, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS k))")
    + "SELECT symbol, ts, k AS fold, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role FROM fo WHERE i < start + size"
)
def walk_forward_folds(spark, d):
    return split.walk_forward(bars(spark, d)).select("symbol", "ts", "fold", "role")


MD5 = "CAST('0x' || substr(md5(concat_ws('|', symbol, CAST(ts AS VARCHAR), '42')), 1, 8) AS BIGINT)"


@query(with_(*HOURLY) + f"SELECT symbol, ts, CAST({MD5} % 1000000 < 200000 AS BOOLEAN) AS test FROM bars_1h")
def hashed_split(spark, d):
    return split.hashed_split(bars(spark, d)).select("symbol", "ts", (F.col("split") == "test").alias("test"))


@query(with_(*HOURLY) + f"SELECT symbol, ts, CAST({MD5} % 5 AS INTEGER) AS fold FROM bars_1h")
def hashed_folds(spark, d):
    return split.hashed_folds(bars(spark, d)).select("symbol", "ts", "fold")


# --- predictions -------------------------------------------------------------------------------
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three fixed rules per bar and the change they try to predict."""
    c = F.col("close")

    def first(w):
        return {"label": F.try_divide(c, F.lag(c).over(w)) - 1}

    def second(w):
        before = w.rowsBetween(-5, -1)
        last = F.lag("label").over(w)
        return {"last": last, "mean5": F.when(F.count("label").over(before) == 5, F.avg("label").over(before)), "reverse": -last}

    wide = rolling(bars(spark, d), [first, second], back=6)
    rules = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in ("last", "mean5", "reverse")])
    return wide.select("symbol", "ts", "label", F.explode(rules).alias("e")).select("symbol", "ts", "label", "e.*").filter(F.col("prediction").isNotNull())


PRED = (
    *HOURLY,
    f"l0 AS (SELECT symbol, ts, {div('close', lag('close'))} - 1 AS label FROM bars_1h)",
    f"l1 AS (SELECT *, {lag('label')} AS last, CASE WHEN {over('count(label)', '5 PRECEDING AND 1 PRECEDING')} = 5 THEN {over('avg(label)', '5 PRECEDING AND 1 PRECEDING')} END AS mean5 FROM l0)",
    "p AS (SELECT * FROM (SELECT symbol, ts, label, 'last' AS model, last AS prediction FROM l1 UNION ALL SELECT symbol, ts, label, 'mean5', mean5 FROM l1 UNION ALL SELECT symbol, ts, label, 'reverse', -last FROM l1) WHERE prediction IS NOT NULL)",
)
MET = "count(*) AS rows, {} AS mse, {} AS rmse, {} AS mae, {} AS r2, {} AS direction_accuracy".format(
    *[rnd(e, 4) for e in ("avg(pow(label - prediction, 2))", "sqrt(avg(pow(label - prediction, 2)))", "avg(abs(label - prediction))", "1 - avg(pow(label - prediction, 2)) / nullif(var_pop(label), 0)", "avg(CASE WHEN sign(label) = sign(prediction) THEN 1.0 ELSE 0 END)")]
)


@query(with_(*PRED) + f"SELECT model, {MET} FROM p WHERE label IS NOT NULL GROUP BY 1", digits=4)
def regression_metrics(spark, d):
    return metrics.regression(predictions(spark, d), by=["model"])


@query(with_(*PRED) + f"SELECT symbol, model, {rnd('avg(CASE WHEN sign(label) = sign(prediction) THEN 1.0 ELSE 0 END)')} AS direction_accuracy FROM p WHERE label IS NOT NULL GROUP BY 1, 2")
def direction_accuracy(spark, d):
    return metrics.regression(predictions(spark, d), by=["symbol", "model"]).select("symbol", "model", "direction_accuracy")


def model_errors(spark, d):
    return metrics.regression(predictions(spark, d), by=["symbol", "model"]).select("symbol", "model", F.expr("inline(array(struct('mae' AS metric, mae AS value), struct('rmse' AS metric, rmse AS value)))"))


@query(with_(*PRED) + f"SELECT model, {rnd('avg(mae)', 4)} AS mae, {rnd('avg(rmse)', 4)} AS rmse FROM (SELECT symbol, model, avg(abs(label - prediction)) AS mae, sqrt(avg(pow(label - prediction, 2))) AS rmse FROM p WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1", digits=4)
def compare_models(spark, d):
    per_model = model_errors(spark, d).groupBy("model", "metric").agg(F.avg("value").alias("value"))
    return metrics.compare(per_model, names=["mae", "rmse"])


@query(with_(*PRED) + f"SELECT model, 'mae' AS metric, {rnd('avg(mae)', 4)} AS mean, {rnd('stddev_pop(mae)', 4)} AS std_pop, {rnd('stddev_samp(mae)', 4)} AS std, count(*) AS folds FROM (SELECT symbol, model, avg(abs(label - prediction)) AS mae FROM p WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1", digits=4)
def fold_summary(spark, d):
    return metrics.fold_summary(model_errors(spark, d).filter("metric = 'mae'"))


JUDGED = "j AS (SELECT l.quality AS label, 1 - l.toxic AS prediction, CAST(d.n_chars AS DOUBLE) AS score, d.lang FROM labels l JOIN documents d USING (doc_id))"


def judged(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"), F.col("n_chars").cast("double").alias("score"), "lang"
    )


@query(f"WITH {JUDGED} SELECT label, prediction, count(*) AS n FROM j GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(judged(spark, d))


REPORT = (
    JUDGED,
    "cl AS (SELECT DISTINCT label AS class FROM j UNION SELECT DISTINCT prediction FROM j)",
    "cr AS (SELECT class, (SELECT count(*) FROM j WHERE label = class) AS support, (SELECT count(*) FROM j WHERE prediction = class) AS predicted, (SELECT count(*) FROM j WHERE label = class AND prediction = class) AS hit FROM cl)",
    "pr AS (SELECT *, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM cr)",
    "fr AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)",
)


@query(with_(*REPORT) + f"SELECT class, support, predicted, hit, {rnd('precision')} AS precision, {rnd('recall')} AS recall, {rnd('f1')} AS f1 FROM fr")
def class_report(spark, d):
    return metrics.class_report(judged(spark, d))


@query(with_(*REPORT) + "SELECT CAST(sum(support) AS BIGINT) AS rows, {} AS accuracy, {} AS precision, {} AS recall, {} AS f1 FROM fr".format(*[rnd(e) for e in ("sum(hit) / sum(support)", "sum(precision * support) / sum(support)", "sum(recall * support) / sum(support)", "sum(f1 * support) / sum(support)")]))
def class_metrics(spark, d):
    return metrics.classification(judged(spark, d))


@query(with_(*REPORT) + f"SELECT {rnd('precision')} AS precision, {rnd('recall')} AS recall, {rnd('f1')} AS f1 FROM fr WHERE class = 1")
def binary_metrics(spark, d):
    return metrics.binary(judged(spark, d))


@query(
    f"WITH {JUDGED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM j)"
    f" SELECT lang, {rnd('(sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0)')} AS auc FROM r GROUP BY 1"
)
def roc_auc(spark, d):
    return metrics.roc_auc(judged(spark, d), by=["lang"])


# --- blends ------------------------------------------------------------------------------------
WEIGHTS = {"last": 1.0, "mean5": 2.0, "reverse": 0.5}
WSQL = "CASE model WHEN 'last' THEN 1.0 WHEN 'mean5' THEN 2.0 ELSE 0.5 END"


def blended(expr: str, cast: str | None = None) -> str:
    value = f"CAST({expr} AS {cast})" if cast else rnd(expr)
    return with_(*PRED) + f"SELECT symbol, ts, {value} AS prediction FROM p GROUP BY 1, 2"


@query(blended("avg(prediction)"))
def blend_avg(spark, d):
    return blend.average(predictions(spark, d))


@query(blended(f"sum({WSQL} * prediction) / sum({WSQL})"))
def blend_weighted(spark, d):
    return blend.weighted(predictions(spark, d), WEIGHTS)


@query(blended("quantile_cont(prediction, 0.5)"))
def blend_median(spark, d):
    return blend.median(predictions(spark, d))


@query(blended("CASE WHEN sum(CASE WHEN prediction > 0 THEN 1 ELSE -1 END) > 0 THEN 1 ELSE -1 END", "INTEGER"))
def vote_sign(spark, d):
    return blend.sign_vote(predictions(spark, d))


@query(blended(f"CASE WHEN sum({WSQL} * CASE WHEN prediction > 0.5 THEN 1 ELSE 0 END) / 3.5 > 0.5 THEN 1 ELSE 0 END", "INTEGER"))
def vote_threshold(spark, d):
    return blend.threshold_vote(predictions(spark, d), WEIGHTS)


@query(blended(f"CASE WHEN sum({WSQL} / 3.5 * prediction) > 0.5 THEN 1 ELSE 0 END", "INTEGER"))
def vote_soft(spark, d):
    return blend.soft_vote(predictions(spark, d), WEIGHTS)


@query(
    with_(*PRED, "c AS (SELECT symbol, ts, CASE WHEN prediction > 0.2 THEN 1 WHEN prediction < -0.2 THEN -1 ELSE 0 END AS prediction, count(*) AS n FROM p GROUP BY 1, 2, 3)",
          "o AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY n DESC, prediction) AS rn FROM c)")
    + "SELECT symbol, ts, CAST(prediction AS INTEGER) AS prediction FROM o WHERE rn = 1"
)
def vote_majority(spark, d):
    p = F.col("prediction")
    return blend.majority(predictions(spark, d).withColumn("prediction", F.when(p > 0.2, 1).when(p < -0.2, -1).otherwise(0)))


@query(
    with_(*PRED, "e AS (SELECT model, avg(abs(label - prediction)) AS error FROM p WHERE label IS NOT NULL GROUP BY 1)")
    + pick({"error": "error", "weight": "(1 / greatest(error, 1e-10)) / sum(1 / greatest(error, 1e-10)) OVER ()"}, keys="model") + " FROM e"
)
def inverse_error_weights(spark, d):
    errors = metrics.regression(predictions(spark, d), by=["model"]).select("model", F.col("mae").alias("error"))
    return blend.inverse_error_weights(errors)


@query(
    with_(*PRED, "e AS (SELECT symbol, ts, model, avg(pow(label - prediction, 2)) OVER (PARTITION BY symbol, model ORDER BY ts ROWS 19 PRECEDING) AS error FROM p)")
    + pick({"weight": "(1 / greatest(error, 1e-10)) / sum(1 / greatest(error, 1e-10)) OVER (PARTITION BY symbol, ts)"}, keys="symbol, ts, model") + " FROM e"
)
def dynamic_weights(spark, d):
    return blend.dynamic_weights(predictions(spark, d)).select("symbol", "ts", "model", "weight")


AVG = (*PRED, "a AS (SELECT symbol, ts, avg(prediction) AS x FROM p GROUP BY 1, 2)")


def smoothing(name: str, fn, sql: str):
    QUERIES[name] = lambda spark, d: rounded(fn(blend.average(predictions(spark, d)))).select("symbol", "ts", "smoothed")
    SQL[name] = sql


smoothing("smooth_trailing", lambda df: blend.smooth_trailing(df, 5), with_(*AVG) + pick({"smoothed": trailing("avg(x)", 5)}) + " FROM a")
smoothing("smooth_centred", lambda df: blend.smooth_centred(df, 6), with_(*AVG) + pick({"smoothed": over("avg(x)", "3 PRECEDING AND 2 FOLLOWING")}) + " FROM a")
smoothing("smooth_centred_median", lambda df: blend.smooth_centred(df, 5, "median"), with_(*AVG) + pick({"smoothed": over("quantile_cont(x, 0.5)", "2 PRECEDING AND 2 FOLLOWING")}) + " FROM a")
smoothing("smooth_symmetric", lambda df: blend.smooth_symmetric(df, 6), with_(*AVG) + pick({"smoothed": over("avg(x)", "3 PRECEDING AND 3 FOLLOWING")}) + " FROM a")
smoothing(
    "smooth_ewm",
    lambda df: blend.smooth_ewm(df, 9),
    with_(*AVG, *recur("e", "a", [("s", "x", 0.2, 1, 1)]), recursive=True) + pick({"smoothed": "e.s"}, keys="a.symbol, a.ts") + " FROM a JOIN e ON e.symbol = a.symbol AND e.ts = a.ts",
)
smoothing(
    "smooth_ewm_adjusted",
    lambda df: blend.smooth_ewm(df, 9, adjusted=True),
    with_(*AVG, "n AS (SELECT symbol, ts, x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM a)")
    + f"SELECT n.symbol, n.ts, {rnd('sum(pow(0.8, n.i - o.i) * o.x) / sum(pow(0.8, n.i - o.i))')} AS smoothed FROM n JOIN n o ON o.symbol = n.symbol AND o.i <= n.i GROUP BY 1, 2",
)


def ewm_on_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Every event by time, so a minute holds any number of rows."""
    ticks = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("prediction"))
    return rounded(blend.smooth_ewm(ticks, 9)).select("symbol", "ts", "smoothed")


QUERIES["ewm_on_ticks"] = ewm_on_ticks
SQL["ewm_on_ticks"] = (
    with_("t AS (SELECT event_type AS symbol, ts, value AS x FROM events)", *recur("e", "t", [("s", "x", 0.2, 1, 1)]), recursive=True)
    + pick({"smoothed": "e.s"}, keys="e.symbol, e.ts")
    + " FROM e"
)


# --- strategy ----------------------------------------------------------------------------------
def paced(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-bar mean price and its percent change as the prediction."""
    c = F.col("px")
    out = rolling(
        bars(spark, d),
        [lambda w: {"px": F.avg("close").over(last_rows(w, 20))}, lambda w: {"prediction": 100 * (F.try_divide(c, F.lag(c).over(w)) - 1)}],
        back=21,
    )
    return out.select("symbol", "ts", c.alias("close"), "prediction")


PACED = (*HOURLY, f"px AS (SELECT symbol, ts, {trailing('avg(close)', 20)} AS close FROM bars_1h)", f"pc AS (SELECT *, 100 * ({div('close', lag('close'))} - 1) AS prediction FROM px)")


def held_sql(threshold: str = "0.5", by: str = "symbol", source: str = "pc") -> list[str]:
    o = f"OVER (PARTITION BY {by} ORDER BY ts"
    return [
        f"s0 AS (SELECT *, coalesce(lag(prediction) {o}), 0) AS p FROM {source})",
        f"s1 AS (SELECT *, sum(p) {o} ROWS 4 PRECEDING) / 5 AS mean FROM s0)",
        f"s2 AS (SELECT *, CASE WHEN p > greatest({threshold}, 0.5) AND mean > 0 THEN 1 WHEN p < -greatest({threshold}, 0.5) AND mean < 0 THEN -1 ELSE 0 END AS signal FROM s1)",
        f"s3 AS (SELECT *, CASE WHEN lag(signal) {o}) = signal AND lag(signal, 2) {o}) = signal THEN signal END AS direction FROM s2 WHERE signal <> 0)",
        f"s4 AS (SELECT s2.*, s3.direction FROM s2 LEFT JOIN s3 USING ({by}, ts))",
        f"s5 AS (SELECT *, CAST(coalesce(last_value(direction IGNORE NULLS) {o} ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS position FROM s4)",
    ]


def equity_sql(fee: str = "0.001", leverage: str = "1.0", by: str = "symbol", source: str = "s5") -> list[str]:
    o = f"OVER (PARTITION BY {by} ORDER BY ts"
    return [
        f"n0 AS (SELECT *, coalesce(lag(position) {o}), 0) AS was, coalesce(close / nullif(lag(close) {o}), 0) - 1, 0) AS ch FROM {source})",
        f"n1 AS (SELECT *, was * ch * {leverage} - abs(position - was) * ({fee} + 0.0005) AS net_return FROM n0)",
        f"n2 AS (SELECT *, CASE WHEN max(CASE WHEN net_return <= -1 THEN 1 ELSE 0 END) {o} ROWS UNBOUNDED PRECEDING) = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN net_return > -1 THEN ln(1 + net_return) END) {o} ROWS UNBOUNDED PRECEDING), 0)) END AS equity FROM n1)",
        f"n3 AS (SELECT *, max(equity) {o} ROWS UNBOUNDED PRECEDING) AS peak FROM n2)",
        "n4 AS (SELECT *, equity / nullif(peak, 0) - 1 AS drawdown FROM n3)",
    ]


def held(spark, d):
    return strategy.positions_held(strategy.entry_signals(paced(spark, d)))


@query(with_(*PACED, *held_sql()) + "SELECT symbol, ts, CAST(signal AS INTEGER) AS signal, position FROM s5")
def strategy_positions(spark, d):
    return held(spark, d).select("symbol", "ts", "signal", "position")


@query(with_(*PACED, *held_sql(), *equity_sql()) + pick({"net_return": "net_return"}, keys="symbol, ts, position") + " FROM n4")
def strategy_returns(spark, d):
    return strategy.net_returns(held(spark, d)).select("symbol", "ts", "position", "net_return")


@query(with_(*PACED, *held_sql(), *equity_sql()) + pick({"equity": "equity", "peak": "peak", "drawdown": "drawdown"}, 5) + " FROM n4", digits=5)
def drawdown(spark, d):
    return strategy.equity(strategy.net_returns(held(spark, d))).select("symbol", "ts", "equity", "peak", "drawdown")


def summary_sql(by: str, ppy: float) -> str:
    vol = f"(stddev_samp(net_return) * sqrt({ppy!r}))"
    parts = ["arg_max(equity, ts) - 1", f"avg(net_return) * {ppy!r}", vol, f"coalesce((avg(net_return) * {ppy!r} - 0.01) / nullif({vol}, 0), 0)", "min(drawdown)"]
    return f"SELECT {by}, count(*) AS bars, {{}} AS total_return, {{}} AS annual_return, {{}} AS annual_volatility, {{}} AS sharpe, {{}} AS max_drawdown FROM n4 GROUP BY {by}".format(*[rnd(p, 5) for p in parts])


@query(with_(*PACED, *held_sql(), *equity_sql()) + summary_sql("symbol", 8760.0), digits=5)
def strategy_summary(spark, d):
    return strategy.summary(strategy.equity(strategy.net_returns(held(spark, d))), periods_per_year=8760.0)


TRADES_SQL = [
    "t0 AS (SELECT symbol, ts, close, position, coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0) AS was FROM {src})",
    "t1 AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS exit_ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS exit_price FROM t0 WHERE position <> was)",
    "t2 AS (SELECT symbol, ts AS entry_ts, exit_ts, CAST(sign(position) AS INTEGER) AS side, close AS entry_price, exit_price, sign(position) * (exit_price - close) AS profit FROM t1 WHERE position <> 0 AND exit_ts IS NOT NULL)",
]
TRADE_COLS = pick({c: c for c in ("entry_price", "exit_price", "profit")}, keys="symbol, entry_ts, exit_ts, side") + " FROM t2"


@query(with_(*PACED, *held_sql(), *[t.format(src="s5") for t in TRADES_SQL]) + TRADE_COLS)
def trades(spark, d):
    return strategy.trades(held(spark, d))


LONG = "lo AS (SELECT symbol, ts, close, CASE WHEN signal > 0 THEN 1 ELSE 0 END AS position FROM s2 WHERE signal >= 0)"


def long_trades(spark, d):
    by_signal = strategy.entry_signals(paced(spark, d)).withColumn("position", F.col("signal"))
    return strategy.trades(by_signal, long_only=True)


@query(with_(*PACED, *held_sql()[:3], LONG, *[t.format(src="lo") for t in TRADES_SQL]) + TRADE_COLS)
def trades_long_only(spark, d):
    return long_trades(spark, d)


@query(
    with_(*PACED, *held_sql()[:3], LONG, *[t.format(src="lo") for t in TRADES_SQL])
    + "SELECT symbol, count(*) AS trades, {} AS win_rate, {} AS profit_loss_ratio, {} AS profit FROM t2 GROUP BY 1".format(
        *[rnd(e) for e in ("count(*) FILTER (WHERE profit > 0) * 100.0 / count(*)", "abs(sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / nullif(sum(CASE WHEN profit < 0 THEN profit ELSE 0 END), 0))", "sum(profit)")]
    )
)
def trade_stats(spark, d):
    return strategy.trade_stats(long_trades(spark, d))


THRESHOLDS, FEES, LEVERAGES = (0.5, 1.0), (0.0005, 0.002), (1.0, 2.0)


@query(
    with_(
        *PACED,
        "fan AS (SELECT pc.*, threshold FROM pc, (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS threshold))",
        *held_sql("threshold", "symbol, threshold", "fan"),
        "fan2 AS (SELECT s5.*, fee, leverage FROM s5, (SELECT unnest([0.0005, 0.002]::DOUBLE[]) AS fee), (SELECT unnest([1.0, 2.0]::DOUBLE[]) AS leverage))",
        *equity_sql("fee", "leverage", "symbol, threshold, fee, leverage", "fan2"),
    )
    + summary_sql("symbol, threshold, fee, leverage", 8760.0),
    digits=5,
)
def param_sweep(spark, d):
    return strategy.sweep(paced(spark, d), THRESHOLDS, FEES, LEVERAGES, periods_per_year=8760.0)

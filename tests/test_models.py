import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import split
from tickloom.operators.metrics import regression
from tickloom.plans import analysis, gram, models, selection


@pytest.fixture(scope="module")
def planted(spark):
    """y = 3a - 2b + noise; c is unrelated."""
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=n)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("S", t0 + dt.timedelta(hours=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, c double, y double").cache()


COLS = ["a", "b", "c"]


@pytest.mark.parametrize("kind,params", [("linear", {}), ("ridge", {"regParam": 0.01}), ("lasso", {"regParam": 0.01}), ("forest", {"numTrees": 10}), ("gbt", {"maxIter": 10})])
def test_regressors_beat_the_mean(planted, kind, params):
    parts = split.chronological(planted)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    scored = models.predict(models.fit(train, COLS, "y", kind, **params), test)
    assert regression(scored, "y").first()["r2"] > 0.6


@pytest.mark.parametrize("kind,params", [("logistic", {"maxIter": 10}), ("forest_classifier", {"numTrees": 10}), ("gbt_classifier", {"maxIter": 5}), ("linear_svm", {"maxIter": 5})])
def test_classifiers_beat_chance(planted, kind, params):
    rows = planted.withColumn("up", (F.col("y") > 0).cast("double"))
    out = models.predict(models.fit(rows, COLS, "up", kind, **params), rows)
    assert out.agg(F.avg((F.col("up") == F.col("prediction")).cast("double"))).first()[0] > 0.85


def test_least_squares_and_save(spark, planted, tmp_path):
    beta = {r["term"]: r["coefficient"] for r in models.least_squares(planted, COLS, "y").collect()}
    pdf = planted.toPandas()
    want = np.linalg.lstsq(np.c_[pdf[COLS], np.ones(len(pdf))], pdf["y"], rcond=None)[0]
    np.testing.assert_allclose([beta[c] for c in [*COLS, "intercept"]], want, rtol=1e-9, atol=1e-12)
    model = models.fit(planted, COLS, "y")
    models.save(model, str(tmp_path / "m"), COLS, kind="linear")
    again, meta = models.load(spark, str(tmp_path / "m"))
    assert meta == {"features": COLS, "kind": "linear"}
    assert models.predict(again, planted).agg(F.sum("prediction")).first() == models.predict(model, planted).agg(F.sum("prediction")).first()


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=50.0, size=(12, 3))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 3))
    x[: n // 3] = x[0]  # a third of all rows are one point
    return x, rng.integers(0, 3, n).astype(float)


@pytest.mark.parametrize("pivots", [1, 16, 1024])
def test_neighbours_visit_few_blocks_of_clustered_rows(spark, pivots):
    x, y = clustered(400)
    df = spark.createDataFrame([(f"r{i:04d}", *map(float, x[i]), float(y[i])) for i in range(400)], "id string, a double, b double, c double, y double")
    odd = spark.createDataFrame([("none", None, 1.0, 1.0, 1.0), ("nan", float("nan"), 1.0, 1.0, 1.0), ("far", 1e6, 0.0, 0.0, None)], df.schema)
    got = models.nearest(df.unionByName(odd), df.unionByName(odd), list("abc"), "y", "id", 4, block_rows=30, pivots=pivots).toPandas().set_index("id")
    assert len(got) == 401 and "far" in got.index
    for i in range(400):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = np.argsort(d, kind="stable")[:4]
        assert [(r["near"], r["label"]) for r in got.loc[f"r{i:04d}", "neighbours"]] == [(f"r{j:04d}", y[j]) for j in want]
    if pivots > 1:
        assert got["visited"].sum() < 0.5 * got["blocks"].sum()
    assert models.nearest(df.limit(0), df, list("abc"), "y", "id", 4).count() == 0


def test_neighbours_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 3, 300).astype(float)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    got = models.nearest(df, df, list("abcd"), "y", "id", 5, block_rows=70).toPandas().set_index("id")
    assert len(got) == 300
    for i in range(300):
        want = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:5]
        assert sorted(r["near"] for r in got.loc[i, "neighbours"]) == sorted(want)


def test_neighbours_without_clusters_meet_blocks_not_cells(spark):
    """Where the triangle inequality leaves all, visits follow the blocks that the rows fill, not the pivots."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(300, 24)), [3] * 100 + [1] * 200, axis=0).astype("f4").astype(float)
    rows = [(i, v, float(i % 7)) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "id long, v array<float>, y double").repartition(5)
    got = models.nearest(df, df, ["v"], "y", "id", 4, block_rows=200).toPandas().set_index("id")
    assert got["blocks"].max() <= 6 and len(got) == 500
    for i in range(500):
        want = np.argsort(np.sqrt(((x - x[i]) ** 2).sum(1)), kind="stable")[:4]
        assert [(r["near"], r["label"]) for r in got.loc[i, "neighbours"]] == [(j, j % 7) for j in want]


def test_best_of_a_block_equals_brute_force():
    from tickloom.operators import neighbours

    rng = np.random.default_rng(1)
    spread = np.concatenate([rng.normal(size=(80, 5)), 1e-6 * rng.normal(size=(60, 5)), 1e7 + rng.normal(size=(30, 5)), np.zeros((40, 5)), 1e-25 * rng.normal(size=(20, 5))])
    for train in (spread, spread[:3], spread[170:210]):
        order = rng.permutation(len(train))
        right = pd.DataFrame({"_id": order, "_x": list(train[order]), "_label": order * 1.0})
        d = np.sqrt(((spread[:, None] - train[None]) ** 2).sum(2))
        bounds = np.where(np.arange(len(spread)) % 3 == 0, np.sort(d, axis=1)[:, 1], 1e9)
        left = pd.DataFrame({"_id": np.arange(len(spread)), "_x": list(spread), "_bound": bounds})
        got = neighbours._best(left, right, 4).groupby("_id")["near"].apply(list)
        for i in range(len(spread)):
            want = [j for j in np.argsort(d[i], kind="stable")[:4] if d[i, j] <= bounds[i]]
            assert got[i] == want


def test_importances_find_the_signal(spark, planted):
    model = models.fit(planted, COLS, "y", "linear")
    perm = {r["feature"]: r["score"] for r in selection.permutation_importance(model, planted, COLS, "y", repeats=2).collect()}
    assert perm["a"] > perm["b"] > 1 > abs(perm["c"])
    rank = {r["feature"]: r["rank"] for r in selection.recursive_elimination(planted, COLS, "y", 1, "linear").collect()}
    assert rank == {"a": 1, "b": 2, "c": 3}


def test_donors_are_a_bijection(spark, planted):
    for rows in (1, 2, 3, 10, 99, 100, 101, 5000):
        for seed in (1, 2):
            got = selection.dealt(np.arange(rows), rows, seed)
            assert sorted(got) == list(range(rows))
    assert (selection.dealt(np.arange(5000), 5000, 1) != selection.dealt(np.arange(5000), 5000, 2)).mean() > 0.99
    table = spark.range(300).select(F.col("id").alias("_pos"), F.array(F.col("id").cast("double")).alias("_x"), F.lit(0.0).alias("_y"))
    moved = selection.donors(table, 2, 7, 300).toPandas()
    assert all(sorted(v[0] for v in moved[moved["_repeat"] == r]["_d"]) == list(range(300)) for r in (0, 1))


@pytest.mark.parametrize("kind,params", [("linear", {}), ("ridge", {"regParam": 0.3}), ("lasso", {"regParam": 0.05}), ("elastic_net", {"regParam": 0.1, "elasticNetParam": 0.4})])
def test_fits_from_sums_equal_fitted_models(spark, planted, kind, params):
    rows = planted.withColumn("d", F.col("a") * 1e6 + F.col("c") * 1e5 + 1e7).withColumn("e", F.lit(3.0)).unionByName(planted.withColumns({"d": F.lit(None).cast("double"), "e": F.lit(1.0)}))
    cols = ["a", "b", "c", "d"]
    folds = split.time_segments(rows, 2, gap=3)
    sums = gram.Moments(folds, cols, "y")
    for k in folds.roles:
        found = gram.fit_sums(sums.over(folds.roles[k][0]), [0, 1, 2, 3] if kind != "linear" else [0, 1, 2], kind, **params)
        model = models.fit(folds.train(k).filter("d IS NOT NULL"), cols if kind != "linear" else cols[:3], "y", kind, **({"maxIter": 1000, "tol": 1e-12} | params)).stages[-1]
        want = [*model.coefficients.toArray(), *([0.0] if kind == "linear" else [])]
        scale = np.array([1.0, 1.0, 1.0, 1e6])
        np.testing.assert_allclose(found.beta * scale, want * scale, atol=2e-4)
    # a constant column and a sum of others add nothing
    same = rows.withColumn("f", F.col("a") + F.col("b"))
    wide = gram.Moments(split.hashed_segments(same, 2), ["a", "b", "f", "e"], "y")
    fit = gram.fit_sums(wide.over([0, 1]), [0, 1, 2, 3])
    assert fit.beta[2] == 0 and abs(fit.beta[0] - 3) < 0.1


def test_segments_are_the_folds_without_copies(planted):
    key = lambda df: sorted(r["ts"] for r in df.select("ts").collect())
    for copies, folds in (
        (split.time_folds(planted, 3, gap=5), split.time_segments(planted, 3, gap=5)),
        (split.walk_forward(planted, steps=4), split.walk_segments(planted, steps=4)),
        (models.roles_from_fold(split.hashed_folds(planted, 3), 3), split.hashed_segments(planted, 3)),
    ):
        assert folds.rows.count() == 600
        named = split.as_folds(copies)
        assert set(folds.roles) == set(named.roles)
        for k in folds.roles:
            assert key(folds.train(k)) == key(named.train(k)) and key(folds.test(k)) == key(named.test(k))


def test_a_search_stores_one_table_and_scores_as_fitted_models_do(planted, monkeypatch):
    from tickloom.operators import split as module

    stored = []
    monkeypatch.setattr(module, "cut_lineage", lambda df, keep=module.cut_lineage: stored.append(1) or keep(df))
    candidates = models.grid({"regParam": [0.01, 1.0], "columns": [COLS, ["a"]]})
    found = models.search(split.time_segments(planted, 2), COLS, "y", "ridge", candidates, "mae")
    assert len(stored) == 1
    again = models.search(split.time_segments(planted, 2), COLS, "y", "ridge", [{**c, "maxIter": 100} for c in candidates], "mae")
    assert [p for p, _ in found] == [{k: v for k, v in p.items() if k != "maxIter"} for p, _ in again]
    assert [v for _, v in found] == pytest.approx([v for _, v in again], abs=1e-6)
    assert len(stored) == 2


def test_validation_and_search(planted):
    folded = split.time_folds(planted, 3, gap=2)
    table = models.cross_validate(folded, COLS, "y").toPandas()
    assert set(table["fold"]) == {0, 1, 2} and (table[table["metric"] == "r2"]["value"] > 0.9).all()
    found = models.search(folded, COLS, "y", "ridge", models.grid({"regParam": [0.001, 100.0]}))
    assert found[0][0] == {"regParam": 0.001}
    assert models.random_grid({"a": range(10)}, 3) == models.random_grid({"a": range(10)}, 3)
    meta, wide = models.stack(folded, COLS, "y", {"lin": ("linear", {}), "far": ("ridge", {"regParam": 1000.0})})
    assert regression(models.predict(meta, wide)).first()["r2"] > 0.9
    weights = models.stacking_weights(wide, ["lin", "far"])
    assert sum(weights.values()) == pytest.approx(1.0)
    chosen, _ = selection.elimination_with_folds(folded, COLS, "y", "linear")
    assert {"a", "b"} <= set(chosen)


def test_analysis_run(spark, planted, tmp_path):
    tables = analysis.run(planted, COLS, "y", str(tmp_path), threshold=0.5)
    assert [r["feature"] for r in tables["selected"].orderBy("rank").collect()][:2] == ["a", "b"]
    assert spark.read.parquet(str(tmp_path / "profile")).count() == 3


def test_predict_keeps_all_rows(spark):
    from tickloom.plans.models import fit, predict

    rows = [(float(i), float(i * 2), float(3 * i)) for i in range(50)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0), (float("nan"), 2.0, 2.0)], "a double, b double, y double")
    for kind in ("linear", "forest"):
        got = predict(fit(df, ["a", "b"], "y", kind), df).collect()
        assert len(got) == 52 and sum(r.prediction is None for r in got) == 2


def test_nearest_far_from_zero_and_with_ties(spark):
    from tickloom.plans.models import nearest

    train = spark.createDataFrame([(i, 1e8 + v, 0.0, float(i)) for i, v in enumerate([0.0, 0.5, 1.0, 0.5, 0.5])], "id int, x double, z double, y double")
    got = nearest(train, train.filter("id = 0"), ["x", "z"], "y", "id", 3).first().neighbours
    assert [(n.near, n.dist) for n in got] == [(0, 0.0), (1, 0.5), (3, 0.5)]

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from conftest import bar_frame, ordered, to_bars, walk
from pyspark.sql import functions as F

from tickloom.operators import align, blend, clean, labels, metrics, prep, quality, ranks, select, split, strategy
from tickloom.operators.resample import resample, ticks_to_bars
from tickloom.sources import files


def test_resample_twice_equals_once(spark):
    df = to_bars(spark, bar_frame(walk(200), "A"), bar_frame(walk(100, 3), "B"))
    once = resample(df, "1d").orderBy("symbol", "ts").toPandas()
    twice = resample(resample(df, "4h"), "1d").orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(once, twice)


def test_gap_rows_and_fill(spark):
    frame = bar_frame(walk(10)).drop(index=[3, 4, 7])
    out = ordered(clean.fill_bars(resample(to_bars(spark, frame), "1h", fill_gaps=True)), "close", "volume")
    assert len(out) == 10 and out["volume"][3] == 0 and out["close"][4] == frame["close"][2] and out["close"].notna().all()


def test_hot_key_deduplicates(spark):
    df = spark.range(5000).select(F.lit("A").alias("symbol"), F.lit("1h").alias("timeframe"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    first = clean.dedupe(df, ["id"], "first", ["symbol", "timeframe", "k"])
    last = clean.dedupe(df, ["id"], "last", ["symbol", "timeframe", "k"])
    assert first.count() == last.count() == 1001
    assert first.filter("k = 0").first()["id"] == 0 and last.filter("k = 0").first()["id"] == 3999


def test_latest_rows(spark):
    got = ordered(clean.latest(to_bars(spark, bar_frame(walk(300), "A"), bar_frame(walk(3), "B")), 5), "symbol", "recency")
    assert got.groupby("symbol").size().to_dict() == {"A": 5, "B": 3}


def test_asof_availability(spark):
    base = to_bars(spark, bar_frame(np.arange(24.0)))
    coarse = resample(base, "4h").select("symbol", "ts", "close")
    at = lambda df, h: df.filter(F.hour("ts") == h).first()["4h_close"]
    now = align.asof(base.select("symbol", "ts"), {"4h": coarse}, available=False)
    later = align.asof(base.select("symbol", "ts"), {"4h": coarse}, available=True)
    assert [at(now, h) for h in (8, 11, 12)] == [11.0, 11.0, 15.0]
    assert [at(later, h) for h in (3, 8, 11, 12, 15)] == [None, 7.0, 7.0, 11.0, 11.0]


def test_integrate_refuses_finer_tables(spark):
    df = to_bars(spark, bar_frame(walk(10)))
    with pytest.raises(ValueError):
        align.integrate({"1h": df, "4h": df}, "4h", {"1h": ["close"], "4h": ["close"]})


def test_labels(spark):
    df = to_bars(spark, bar_frame([1.0, 2.0, 4.0, 2.0, 1.0]))
    ahead = ordered(labels.targets(df, [1], "forward", volatility=False), "target_pct_1", "target_direction_1")
    np.testing.assert_allclose(ahead["target_pct_1"].astype(float), [100, 100, -50, -50, np.nan])
    assert ahead["target_direction_1"].tolist() == [1, 1, 0, 0, 0]
    back = ordered(labels.targets(df, [1], "trailing", volatility=False), "target_pct_1")
    np.testing.assert_allclose(back["target_pct_1"].astype(float), [np.nan, 100, 100, -50, -50])
    seq = labels.sequences(df, ["close"], 2, "close").orderBy("ts").collect()
    assert [[x["close"] for x in r["sequence"]] + [r["label"]] for r in seq] == [[1, 2, 4], [2, 4, 2], [4, 2, 1]]


def test_label_volatility_matches_a_loop(spark):
    x = walk(40, 7)
    got = ordered(labels.targets(to_bars(spark, bar_frame(x)), [6]), "target_volatility_6")["target_volatility_6"].astype(float)
    want = [np.std(np.diff(x[t : t + 6]) / x[t : t + 5], ddof=1) * 252**0.5 if t + 6 < 40 else np.nan for t in range(40)]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_label_volatility_of_long_horizons_and_missing_prices(spark, monkeypatch):
    monkeypatch.setattr("tickloom.operators.series.CHUNK_ROWS", 64)
    x = walk(230, 3)
    x[[50, 51, 130]] = np.nan
    got = ordered(labels.targets(to_bars(spark, bar_frame(x)), [3, 2, 100, 129]), *[f"target_volatility_{h}" for h in (2, 3, 100, 129)]).astype(float)
    ret = np.r_[np.nan, x[1:] / x[:-1] - 1]
    for h in (3, 100, 129):
        want = [np.nanstd(ret[t + 1 : t + h], ddof=1) * 252**0.5 if t + h < 230 and not np.isnan(x[t + h]) and (~np.isnan(ret[t + 1 : t + h])).sum() > 1 else np.nan for t in range(230)]
        np.testing.assert_allclose(got[f"target_volatility_{h}"], want, rtol=1e-9)
    assert got["target_volatility_2"].isna().all()


@pytest.mark.parametrize("rows", [1, 7, 60, 5000])
def test_latest_rows_over_buckets(spark, two_series, rows):
    df, pdf = two_series
    got = clean.latest(df, rows, bucket=F.expr("floor(unix_micros(CAST(ts AS TIMESTAMP)) / 36000000000)")).toPandas()
    for s, own in pdf.groupby("symbol"):
        want = own.sort_values("ts", ascending=False)["ts"].head(rows).tolist()
        assert got[got["symbol"] == s].sort_values("recency")["ts"].tolist() == want


@pytest.mark.parametrize("edges", [None, 4, 256])
def test_exact_quantiles_with_ties(spark, edges):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 999 + ["b"] * 10, "v": np.concatenate([np.where(rng.random(999) < 0.4, 7.0, rng.normal(0, 10, 999)), np.arange(10.0)])})
    got = ranks.quantiles(spark.createDataFrame(pdf), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p87": 0.87}, edges).orderBy("g").toPandas()
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.87]).unstack().to_numpy()
    np.testing.assert_allclose(got[["p10", "p50", "p87"]].to_numpy(), want, rtol=1e-12)


def test_large_slots_are_split_again(spark):
    """Most distinct values crowd together, and one group has nearly all of them."""
    rng = np.random.default_rng(9)
    crowd = np.r_[rng.normal(0, 1e-6, 900), rng.normal(0, 1e6, 100), np.zeros(400)]
    pdf = pd.DataFrame({"g": ["a"] * 1400 + ["b"] * 5, "v": np.r_[crowd, np.arange(5.0)]})
    df = spark.createDataFrame(pdf)
    counts = df.groupBy("g", "v").agg(F.count("*").alias("_cnt"))
    for parts in (2, 40):
        placed = ranks.slotted(counts, ["g"], "v", parts, slot_values=25).toPandas()
        assert len(placed) == counts.count() and placed.groupby(["g", "_slot"]).size().max() <= 25
        for _, own in placed.groupby("g"):
            assert own.sort_values("v")["_slot"].is_monotonic_increasing
    got = ranks.value_counts(df, ["g"], "v", slot_values=25).toPandas().sort_values(["g", "v"])
    for g, own in got.groupby("g"):
        v = np.sort(pdf[pdf["g"] == g]["v"])
        assert own["_cum"].tolist() == [int((v <= x).sum()) for x in own["v"]] and own["_dense"].tolist() == list(range(len(own))) and (own["_n"] == len(v)).all()
    one = ranks.value_counts(df, [], "v", slot_values=100).agg(F.max("_cum"), F.max("_dense"), F.min("_n")).first()
    assert tuple(one) == (1405, counts.select("v").distinct().count() - 1, 1405)


def test_rank_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.integers(0, 20, 400).astype(float), "y": rng.normal(0, 1, 400).round(1)})
    pdf["y"] += pdf["x"] / 10
    df = spark.createDataFrame(pdf)
    spearman = select.correlations(df, ["x", "y"], "spearman").first()["r"]
    x, y = pdf["x"].rank(), pdf["y"].rank()
    assert spearman == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
    sx, sy = np.sign(np.subtract.outer(pdf["x"].to_numpy(), pdf["x"].to_numpy())), np.sign(np.subtract.outer(pdf["y"].to_numpy(), pdf["y"].to_numpy()))
    tau = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
    assert select.correlations(df, ["x", "y"], "kendall").first()["r"] == pytest.approx(tau, abs=1e-12)


def test_kendall_of_all_pairs_skips_missing_sides_and_runs_the_same_jobs(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({c: rng.integers(0, k, 120).astype(float) for c, k in (("a", 3), ("b", 50), ("c", 7), ("d", 1))})
    pdf.loc[rng.random(120) < 0.2, "a"], pdf.loc[rng.random(120) < 0.2, "c"] = None, None
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, d double")

    def run(cols):
        group = f"kendall-{len(cols)}"
        spark.sparkContext.setJobGroup(group, group)
        found = {(r["a"], r["b"]): r["r"] for r in select.kendall_matrix(df, cols).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    got, jobs = run(list("abcd"))
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna()
        sx, sy = (np.sign(np.subtract.outer(both[c].to_numpy(), both[c].to_numpy())) for c in (x, y))
        size = np.sqrt((sx**2).sum() * (sy**2).sum())
        assert (r is None) if size == 0 else r == pytest.approx((sx * sy).sum() / size, abs=1e-12)
    assert len(got) == 6 and jobs <= run(["a", "b"])[1] + 2


def test_auc_edge_cases(spark):
    one = spark.createDataFrame([(1, 0.1), (1, 0.2)], "label int, score double")
    assert metrics.roc_auc(one).first()["auc"] is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(tied).first()["auc"] == pytest.approx(0.875)


def test_split_boundaries(spark):
    df = to_bars(spark, bar_frame(walk(53), "A"), bar_frame(walk(50), "B"))
    counts = {r["split"]: r["count"] for r in split.chronological(df).groupBy("split").count().collect()}
    assert counts == {"train": 72, "validation": 15, "test": 16}
    folds = split.time_folds(df, 3, gap=4).groupBy("fold", "role").agg(F.count("*").alias("n"), F.max("ts").alias("hi"), F.min("ts").alias("lo")).collect()
    by = {(r["fold"], r["role"]): r for r in folds}
    assert [by[k, "test"]["n"] for k in range(3)] == [25, 25, 25] and [by[k, "train"]["n"] for k in range(3)] == [24, 49, 74]
    assert all(by[k, "train"]["hi"] <= by[k, "test"]["lo"] for k in range(3))


def test_votes_and_weights(spark):
    rows = [("A", 1, "m1", 1), ("A", 1, "m2", 2), ("A", 2, "m1", 2), ("A", 2, "m2", 2)]
    df = spark.createDataFrame(rows, "symbol string, ts int, model string, prediction int")
    assert [r["prediction"] for r in blend.majority(df).orderBy("ts").collect()] == [1, 2]
    assert [r["prediction"] for r in blend.sign_vote(df, 1).orderBy("ts").collect()] == [-1, 1]
    heavy = blend.weighted(df, {"m1": 3.0, "m2": 1.0}).orderBy("ts").collect()
    assert heavy[0]["prediction"] == pytest.approx(1.25)
    with pytest.raises(ValueError):
        blend.weight_of({"m1": 1.0, "m2": -1.0})


@pytest.mark.parametrize("chunk_rows", [8, 16384])
def test_sweep_equals_one_run_for_each_set(spark, chunk_rows):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("A", 90), ("B", 37), ("C", 1), ("gone", 30)):
        price = 100 + np.cumsum(rng.normal(0, 2, n))
        if s == "gone":
            price[12:] = 1000.0  # shorts lose more than everything
        p = np.repeat(rng.normal(0, 2, n), 4)[:n] if s != "gone" else np.full(n, -3.0)
        rows += [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i % 17 == 5 else float(price[i]), None if i % 13 == 7 else float(p[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, prediction double")
    got = strategy.sweep(df, [0.2, 1.5], [0.0, 0.01], [1.0, 3.0], chunk_rows=chunk_rows).toPandas().set_index(["symbol", "threshold", "fee", "leverage"]).sort_index()
    for t in (0.2, 1.5):
        held = strategy.positions_held(strategy.entry_signals(df, threshold=t)).cache()
        for fee in (0.0, 0.01):
            for v in (1.0, 3.0):
                want = strategy.summary(strategy.equity(strategy.net_returns(held, fee=fee, leverage=v))).toPandas().set_index("symbol")
                for s in want.index:
                    for c in ("bars", "total_return", "annual_return", "annual_volatility", "sharpe", "max_drawdown"):
                        np.testing.assert_allclose(got.loc[(s, t, fee, v), c], want.loc[s, c], rtol=1e-9, atol=1e-9, err_msg=f"{s} {t} {fee} {v} {c}")
    assert got.loc["gone"]["max_drawdown"].min() == -1


def test_strategy_against_a_loop(spark):
    rng = np.random.default_rng(8)
    n = 300
    pred, price = rng.normal(0.2, 1.0, n).cumsum() * 0.3, walk(n, 2)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h").astype("datetime64[us]"), "close": price, "prediction": pred})
    df = spark.createDataFrame([(r.symbol, r.ts.to_pydatetime(), r.close, r.prediction) for r in pdf.itertuples()], "symbol string, ts timestamp_ntz, close double, prediction double")
    out = strategy.equity(strategy.net_returns(strategy.positions_held(strategy.entry_signals(df)))).orderBy("ts").toPandas()
    position, run, last, log, peak = 0, 0, 0, 0.0, -np.inf
    recent = [0.0] * 5
    for i in range(n):
        p = pred[i - 1] if i else 0.0
        recent = recent[1:] + [p]
        mean = sum(recent) / 5
        s = 1 if p > 0.5 and mean > 0 else -1 if p < -0.5 and mean < 0 else 0
        before = position
        if s:
            run = run + 1 if s == last else 1
            last = s
            if run >= 3:
                position = s
        r = before * (price[i] / price[i - 1] - 1 if i else 0.0) - abs(position - before) * 0.0015
        log += np.log1p(r)
        peak = max(peak, np.exp(log))
        assert out["position"][i] == position
        assert out["drawdown"][i] == pytest.approx(np.exp(log) / peak - 1, abs=1e-9)


def test_greedy_and_overlap(spark):
    scores = spark.createDataFrame([("a", "m", 3.0), ("b", "m", 2.0), ("c", "m", 1.0)], "feature string, method string, score double")
    corr = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.8)], "a string, b string, r double")
    assert select.greedy_uncorrelated(scores, corr) == ["a", "c"]
    groups = {r["feature"]: r["group"] for r in select.correlated_groups(corr).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a"}
    assert [r["feature"] for r in select.above_threshold(scores, 5.0, at_least=2).orderBy("rank").collect()] == ["a", "b"]


def test_quality_reports(spark):
    frame = bar_frame([1.0] * 20 + [100.0])
    df = to_bars(spark, frame.drop(index=[5]))
    gaps = quality.irregular_intervals(df).first()
    assert (gaps["common_step"], gaps["steps"], gaps["irregular"]) == (3600, 19, 1)
    assert quality.outliers(df, ["close"]).first()["outliers"] == 1
    shape = quality.profile(df, ["close"]).first()
    s = frame.drop(index=[5])["close"]
    assert shape["skew"] == pytest.approx(s.skew()) and shape["kurtosis"] == pytest.approx(s.kurt())


def test_preprocessor_uses_training_statistics(spark):
    train, test = to_bars(spark, bar_frame(walk(50))), to_bars(spark, bar_frame(walk(50, 1, 500.0)))
    fitted = prep.Preprocessor(["close"], outliers=None).fit(train)
    values = train.select(F.avg("close"), F.stddev_pop("close")).first()
    got = fitted.transform(test).agg(F.avg("close")).first()[0]
    assert got == pytest.approx((test.agg(F.avg("close")).first()[0] - values[0]) / values[1])


# --- files ---------------------------------------------------------------------------------------
def test_kline_files(spark, tmp_path):
    for month, start in (("2024_01", 1704067200000), ("2024_02", 1706745600000)):
        lines = [f"{start + i * 3600000},1,2,0.5,{i + 1},10,{start + i * 3600000 + 3599999},1.5,3,4,5,0" for i in range(4)]
        (tmp_path / f"BTCUSDT_1h_{month}.csv").write_text("\n".join(lines) + "\n")
    got = files.read_klines(spark, str(tmp_path)).orderBy("ts").collect()
    assert len(got) == 8 and got[0]["ts"] == dt.datetime(2024, 1, 1) and (got[0]["symbol"], got[0]["timeframe"]) == ("BTCUSDT", "1h") and got[3]["close"] == 4.0
    assert files.read_months(spark, str(tmp_path), (2024, 2), (2024, 5)).count() == 4


def test_bar_csv_and_tables(spark, tmp_path):
    (tmp_path / "ETHUSDT_4h.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01 04:00:00,1,2,0.5,1.5,7\n")
    row = files.read_bars_csv(spark, str(tmp_path / "ETHUSDT_4h.csv")).first()
    assert (row["symbol"], row["timeframe"], row["ts"], row["close"]) == ("ETHUSDT", "4h", dt.datetime(2024, 1, 1, 4), 1.5)
    df = to_bars(spark, bar_frame(walk(30), "A"), bar_frame(walk(20), "B"))
    path = str(tmp_path / "table")
    files.write_table(df, path)
    back = files.read_table(spark, path, ["A"], "1h")
    assert back.count() == 30 and "PartitionFilters: [isnotnull(symbol" in back._jdf.queryExecution().toString()
    files.write_features(df, str(tmp_path / "features"))
    assert dict(spark.read.parquet(str(tmp_path / "features")).dtypes)["close"] == "float"
    merged = files.read_with_fallback(spark, df.filter("symbol = 'A'"), df)
    assert merged.count() == 50


def test_checksums(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"one")
    (tmp_path / "b.csv").write_bytes(b"two")
    (tmp_path / "a.csv.CHECKSUM").write_text(hashlib.sha256(b"one").hexdigest() + "  a.csv\n")
    (tmp_path / "b.csv.CHECKSUM").write_text(hashlib.sha256(b"other").hexdigest() + "  b.csv\n")
    got = {r["file"]: r["valid"] for r in files.verify_checksums(spark, f"{tmp_path}/*.csv", f"{tmp_path}/*.CHECKSUM").collect()}
    assert got == {"a.csv": True, "b.csv": False}


def test_tied_ticks_use_the_tie_columns(spark):
    t = dt.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("A", t, 1.0, 1.0, 1), ("A", t, 2.0, 1.0, 2), ("A", t, 3.0, 1.0, 0)], "symbol string, ts timestamp_ntz, price double, size double, id int")
    bar = ticks_to_bars(ticks, "1h", ["id"]).first()
    assert (bar["open"], bar["close"]) == (3.0, 2.0)


def test_a_long_chain_is_one_group(spark):
    from tickloom.operators.select import correlated_groups

    links = [(f"f{i:03d}", f"f{i + 1:03d}", 0.9) for i in range(100)] + [("x", "y", -0.8), ("x", "z", 0.1)]
    got = {r.feature: r.group for r in correlated_groups(spark.createDataFrame(links, "a string, b string, r double")).collect()}
    assert got == {f"f{i:03d}": "f000" for i in range(101)} | {"x": "x", "y": "x"}


def test_wide_correlations(spark):
    import numpy as np
    import pandas as pd

    from tickloom.operators.select import correlations

    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.normal(size=(400, 60)) @ rng.normal(size=(60, 60)) + 1e6, columns=[f"c{i}" for i in range(60)])
    data["c5"] = 0.1
    data = data.mask(rng.random(data.shape) < 0.1)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()], ", ".join(f"{c} double" for c in data.columns)).repartition(5)
    got = {(r.a, r.b): r.r for r in correlations(df, list(data.columns)).collect()}
    want = data.corr()
    assert len(got) == 60 * 59 // 2 and all(got[k] is None for k in got if "c5" in k)
    assert all(abs(v - want.loc[k]) < 1e-9 for k, v in got.items() if v is not None)
    full, some = data.drop(columns="c5").round(0).dropna(subset=["c0", "c1", "c2", "c3"]), ["c0", "c1", "c2", "c3"]
    ranks = {(r.a, r.b): r.r for r in correlations(df.select([F.round(c, 0).alias(c) for c in some]), some, "spearman").collect()}
    assert all(abs(v - full[list(k)].corr("spearman").iloc[0, 1]) < 1e-9 for k, v in ranks.items()) and len(ranks) == 6

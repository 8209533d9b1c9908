import os

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
CHECKED = [
    "bars_1h", "bars_gap_filled", "dedupe_last", "quality_outliers", "distribution_profile", "asof_available", "labels_forward",
    "price_features", "vwap_pvt", "ema", "rsi", "vol_clustering", "f_regression_scores", "chrono_split", "roc_auc", "smooth_centred", "trade_stats", "param_sweep",
    "ewm_on_ticks", "bars_in_csv_files", "bars_in_klines", "bars_in_parquet_table", "file_checksums", "knn_regress", "spearman_matrix",
    "cross_validation", "staged_search", "permutation_of_a_linear_model", "kendall_matrix", "stream_upsert",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "ts", "close", "sma_5", "sma_20"]


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = check_oracle.connect(SF).execute(entry.oracle_sql()[name]).fetchdf()
    assert check_oracle.differences(got, want) == []

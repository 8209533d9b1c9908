import numpy as np
import pytest
from conftest import bar_frame, to_bars, walk

from tickloom.config import CROSS_TIMEFRAME_FEATURES, FeatureConfig, horizon_rows
from tickloom.plans import cross_timeframe as cross


@pytest.fixture(scope="module")
def bars(spark):
    return {tf: to_bars(spark, bar_frame(walk(n, 3), timeframe=tf, freq=freq)).cache() for tf, n, freq in (("1h", 480, "h"), ("4h", 120, "4h"), ("1d", 20, "D"))}


def test_configured_columns_of_all_sizes_are_there(spark, bars):
    table = cross.cross_timeframe_table(bars, config=FeatureConfig(windows={"short": [5]}), volatility=False)
    names = [f"{tf}_{c}" for tf, cols in CROSS_TIMEFRAME_FEATURES.items() for c in cols]
    assert set(names) <= set(table.columns) and {f"target_pct_{h}" for h in horizon_rows("1h")} <= set(table.columns)
    assert table.count() == 480
    with pytest.raises(ValueError):
        cross.cross_timeframe_table(bars, columns={"4h": ["no_such"]}, config=FeatureConfig(groups=("price_based",), windows={"short": [5]}))


def test_training_drops_columns_without_values_and_sees_coarse_bars_when_closed(spark, bars):
    columns = {"1h": ["price_gap"], "4h": ["open_close_diff"], "1d": ["price_volatility"]}
    table = cross.cross_timeframe_table(bars, columns=columns, horizons=[1], config=FeatureConfig(groups=("price_based",)), volatility=False)
    got = table.orderBy("ts").toPandas()
    four = bars["4h"].orderBy("ts").toPandas()
    want = ((four["close"] - four["open"]) / four["open"]).to_numpy()
    for i in (3, 4, 7, 8, 100):
        seen = got["4h_open_close_diff"][i]
        assert np.isnan(seen) if i < 4 else seen == pytest.approx(want[i // 4 - 1])
    model, used, metrics = cross.train_cross_timeframe(table, "target_pct_1", "ridge", regParam=0.1)
    assert used == ["1h_price_gap", "4h_open_close_diff"] and metrics.first()["rows"] == len(got.dropna(subset=[*used, "target_pct_1"])) - int(np.floor(475 * 0.85))

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import local_session

SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", "tickloom-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session


def bar_frame(closes, symbol="A", start="2024-01-01", timeframe="1h", freq="h", volumes=None, spread=1.0):
    closes = pd.Series(closes, dtype=float)
    n = len(closes)
    opens = closes.shift(1).fillna(closes)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "timeframe": timeframe,
            "ts": pd.date_range(start, periods=n, freq=freq).astype("datetime64[us]"),
            "open": opens,
            "high": np.maximum(opens, closes) + spread,
            "low": np.minimum(opens, closes) - spread,
            "close": closes,
            "volume": np.asarray(volumes, float) if volumes is not None else np.arange(n, dtype=float) % 7 + 1,
        }
    )


def to_bars(spark, *frames):
    pdf = pd.concat(frames, ignore_index=True).sample(frac=1.0, random_state=1)
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in (r.symbol, r.timeframe, r.ts.to_pydatetime(), r.open, r.high, r.low, r.close, r.volume)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed=0, base=100.0):
    return base + np.cumsum(np.random.default_rng(seed).normal(0, 1, n))


@pytest.fixture(scope="session")
def two_series(spark):
    """A long hot series and a short one, rows shuffled."""
    frames = [bar_frame(walk(700, 1), "HOT"), bar_frame(walk(60, 2), "COLD")]
    return to_bars(spark, *frames).cache(), pd.concat(frames, ignore_index=True)


def ordered(df, *cols):
    return df.orderBy("symbol", "ts").select(*cols).toPandas()

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import ordered

from registry import models
from tickloom.operators.resample import ticks_to_bars
from tickloom.streaming import bars as live
from tickloom.streaming import upsert

TICKS = "symbol string, ts timestamp, price double, size double"


def write_files(spark, path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}")


@pytest.fixture(scope="module")
def ticks():
    t0 = dt.datetime(2024, 1, 1)
    return [("A" if i % 3 else "B", t0 + dt.timedelta(minutes=7 * i), float(i % 11), float(i % 4)) for i in range(200)]


def test_stream_bars_equal_batch_bars(spark, ticks, tmp_path):
    # A last tick far ahead lets the watermark close every bar before it.
    write_files(spark, tmp_path / "in", TICKS, [ticks[:80], ticks[80:], [("A", dt.datetime(2024, 3, 1), 1.0, 1.0)]])
    stream = live.stream_bars(live.read_ticks(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1), "1h", "2 days")
    query = stream.writeStream.format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("bars_out").withColumn("ts", spark.table("bars_out")["ts"].cast("timestamp_ntz"))
    batch = spark.createDataFrame(ticks, TICKS.replace("timestamp", "timestamp_ntz"))
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    pd.testing.assert_frame_equal(ordered(got, *cols), ordered(ticks_to_bars(batch, "1h"), *cols))


def test_late_ticks_are_dropped(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = None
    for i, rows in enumerate(([("A", t0, 1.0, 1.0)], [("A", t0 + dt.timedelta(days=1), 2.0, 1.0)], [("A", t0, 99.0, 1.0)], [("A", t0 + dt.timedelta(days=3), 2.0, 1.0)])):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = schema or spark.read.parquet(str(tmp_path / "in")).schema
        stream = live.stream_bars(live.read_ticks(spark, str(tmp_path / "in"), schema, 1), "1h", "10 minutes")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    first = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").first()
    assert (first["high"], first["volume"]) == (1.0, 1.0)


SNAPSHOTS = "symbol string, source string, ts timestamp_ntz, last_price double, bid double, ask double, volume_24h double"


def snapshot(minute, price, symbol="A"):
    return (symbol, "x", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), price, 0.0, 0.0, 0.0)


def stream_of(spark, path, schema, batches):
    write_files(spark, path, schema, batches)
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run_upsert(source, path, late="10 minutes", most=8):
    query = upsert.upsert_latest(source, "1h", str(path / "out"), str(path / "cp"), late, most).trigger(availableNow=True).start()
    query.awaitTermination(300)


def test_snapshots_upsert_late_and_repeated(spark, tmp_path):
    batches = [[snapshot(1, 1.0), snapshot(59, 5.0)], [snapshot(30, 3.0), snapshot(59, 5.0)], [snapshot(61, 7.0)], [snapshot(58, 9.0)], [snapshot(61, 6.0)], [snapshot(500, 8.0)], [snapshot(501, 8.0)], [snapshot(59, 99.0)]]
    run_upsert(stream_of(spark, tmp_path / "in", SNAPSHOTS, batches), tmp_path)
    got = ordered(upsert.read_latest(spark, str(tmp_path / "out")), "ts", "open", "close", "volume")
    assert got["close"].tolist() == [5.0, 7.0, 8.0] and (got["volume"] == 0).all() and (got["open"] == got["close"]).all()


def files_in(path):
    return [p for p in (path / "out").rglob("*.parquet")]


def test_files_follow_the_open_bars_not_the_batches(spark, tmp_path):
    symbols = ["A", "B", "C"]
    batches = [[snapshot(20 * i + j, float(i + j), s) for j, s in enumerate(symbols)] + [snapshot(20 * i - 15, -1.0, "A")] for i in range(15)]
    want = {}
    for _, _, ts, price, *_ in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[3])):
        want[ts.replace(minute=0)] = want.get(ts.replace(minute=0), {})
    for s, _, ts, price, *_ in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[3])):
        want[ts.replace(minute=0)][s] = price
    counts, source = [], tmp_path / "in"
    for part in (batches[:8], batches[8:]):
        run_upsert(stream_of(spark, source, SNAPSHOTS, part), tmp_path, "30 minutes", most=2)
        counts.append(len(files_in(tmp_path)))
    got = upsert.read_latest(spark, str(tmp_path / "out")).collect()
    assert sorted((r.ts, r.symbol, r.close) for r in got) == sorted((t, s, p) for t, v in want.items() for s, p in v.items())
    # The day has two folders at most, the open bars one, and as many may wait to be deleted; each has one file.
    assert max(counts) <= 2 * (2 + 1) + 1
    store = upsert.BarStore(spark, str(tmp_path / "out"))
    assert len(store.manifests()) <= 2 and store.read(store.manifest()["open"]).count() <= 6


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([("A", "1h", dt.datetime(2024, 1, 1, h), dt.datetime(2024, 1, 1, h, m), p, p, p, p, 0.0) for h, m, p in r], upsert.SCHEMA)
    upsert.merge_batch(rows((1, 5, 1.0), (2, 5, 2.0)), 0, path, "1h", 0)
    upsert.merge_batch(rows((2, 9, 3.0), (7, 0, 4.0)), 1, path, "1h", 0)
    before = sorted(map(tuple, upsert.read_latest(spark, path).collect()))
    store = upsert.BarStore(spark, path)
    upsert.merge_batch(rows((2, 9, 3.0), (7, 0, 4.0)), 1, path, "1h", 0)  # the manifest is there: nothing is done
    assert sorted(map(tuple, upsert.read_latest(spark, path).collect())) == before
    store.delete("manifest/000000000001.json")  # the files are there, the switch is not
    assert upsert.read_latest(spark, path).count() == 2
    upsert.merge_batch(rows((2, 9, 3.0), (7, 0, 4.0)), 1, path, "1h", 0)
    assert sorted(map(tuple, upsert.read_latest(spark, path).collect())) == before and [r[-2] for r in before] == [1.0, 3.0, 4.0]
    assert upsert.read_latest(spark, str(tmp_path / "none")).count() == 0


def run_ema(spark, tmp_path, batches, late):
    source = stream_of(spark, tmp_path / "in", "symbol string, ts timestamp, close double", batches)
    query = live.stream_ema(source, {"ema_5": 5, "ema_2": 2}, late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out")), query


def test_stream_ema_orders_what_comes_within_the_watermark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live.EmaState, "PIECE", 7)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(hours=i), float((i * 7 + k) % 13)) for i in range(60) for k, s in enumerate("AB")]
    shuffled = sorted(rows, key=lambda r: (r[1] + dt.timedelta(hours=hash((r[1].hour * 7 + r[1].day) % 5)), r[0]))
    batches = [shuffled[i : i + 17] for i in range(0, len(shuffled), 17)] + [[("A", t0 + dt.timedelta(days=90), 1.0)]]
    got, query = run_ema(spark, tmp_path, batches, "12 hours")
    for k, s in enumerate("AB"):
        mine = got.filter(f"symbol = '{s}'").orderBy("ts").toPandas()
        closes = pd.Series([r[2] for r in rows if r[0] == s])
        assert len(mine) == 60
        for span in (5, 2):
            assert mine[f"ema_{span}"].tolist() == pytest.approx(closes.ewm(span=span, adjust=False).mean().tolist())
    assert live.late_rows(query) == 0


def test_stream_ema_counts_late_rows_and_does_not_use_them(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda h, c: ("A", t0 + dt.timedelta(hours=h), c)
    got, query = run_ema(spark, tmp_path, [[row(0, 1.0), row(2, 3.0)], [row(20, 5.0)], [row(20.5, 6.0)], [row(1, 100.0), row(21, 7.0)], [row(500, 0.0)]], "1 hour")
    assert got.orderBy("ts").toPandas()["close"].tolist() == [1.0, 3.0, 5.0, 6.0, 7.0]
    assert live.late_rows(query) == 1


class CountedStates:
    """States of one key as plain values, counting calls and the rows that they read."""

    def __init__(self):
        self.timers, self.calls, self.read = set(), 0, 0

    def registerTimer(self, ms):
        self.timers.add(ms)

    def _state(self, value, size):
        states = self

        class State:
            def exists(self):
                return bool(value)

            def clear(self):
                value.clear()

            def get(self):
                states.calls += 1
                states.read += size(value)
                return iter(list(value)) if size is len else value[0]

            def update(self, new):
                states.calls += 1
                value[:] = [new]

            def appendList(self, new):
                states.calls += len(new)
                value.extend(new)

            def put(self, new):
                states.calls += len(new)
                value[:] = new

            def getValue(self, key):
                states.calls += 1
                states.read += len(value[key][0]) // 16
                return value[key]

            def updateValue(self, key, new):
                states.calls += 1
                value[key] = new

            def removeKey(self, key):
                states.calls += 1
                del value[key]

        return State()

    def getValueState(self, name, schema):
        return self._state([], lambda v: 0)

    def getListState(self, name, schema):
        return self._state([], len)

    def getMapState(self, name, key, value):
        return self._state({}, len)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("repeats", [1, 30])
def test_waiting_rows_are_read_about_once(monkeypatch, repeats):
    """Sixty batches with rows up to three batches out of order, released thirty batches later; with ``repeats`` as many rows of one time."""
    monkeypatch.setattr(live.EmaState, "PIECE", 10)
    monkeypatch.setattr(live.EmaState, "RUN", 4, raising=False)
    rng = np.random.default_rng(5)
    us = np.repeat(np.sort(rng.choice(6_000_000, 6000 // repeats, replace=False)) - 1_000_000, repeats)
    close = rng.integers(0, 50, len(us)).astype(float)
    batch = np.clip((us + 1_000_000) // 100_000 + rng.integers(0, 3, len(us)), 0, 61)
    states, state = CountedStates(), live.EmaState({"e": 0.2, "f": 0.5})
    state.init(states)
    out = []
    for b in range(100):
        some = pd.DataFrame({"us": us[batch == b], "close": close[batch == b]}).sample(frac=1.0, random_state=b)
        list(state.handleInputRows(("A",), iter([some[:37], some[37:]]), None))
        mark = 100 * (b - 30) - 1000
        for ms in sorted(t for t in states.timers if t <= mark):
            states.timers.remove(ms)
            out += [p.assign(b=b) for p in state.handleExpiredTimer(("A",), Watermark(mark), None)]
    got = pd.concat(out, ignore_index=True)
    want = pd.DataFrame({"us": us, "close": close}).sort_values(["us", "close"], ignore_index=True)
    pd.testing.assert_frame_equal(got[["us", "close"]], want)
    for name, alpha in (("e", 0.2), ("f", 0.5)):
        assert got[name].tolist() == pytest.approx(want["close"].ewm(alpha=alpha, adjust=False).mean().tolist(), rel=1e-12)
    assert (got["us"] < 1000 * (100 * (got["b"] - 30) - 1000)).all() and (got["us"] >= 1000 * (100 * (got["b"] - 31) - 1000)).all()
    assert states.read < 4 * len(us) and states.calls < 2 * len(us)


def write_events(spark, path, rows, files):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_files_of_a_stream_follow_the_days_not_the_partitions(spark, tmp_path, monkeypatch):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=2 * (i % 330)), 1, "ab"[i % 2], float(i % 17), None) for i in range(990)]
    d = write_events(spark, tmp_path / "t", rows, 6)

    def read(name, **limits):
        for k, v in limits.items():
            monkeypatch.setattr(models, k, v)
        stream = models.event_batches(spark, d, "event_type AS symbol, ts, value AS close", repeated=True)
        query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = sorted((r.symbol, r.ts, r.close) for r in spark.table(name).filter("symbol <> 'end'").collect())
        assert got == sorted((r[3], r[1], r[4]) for r in rows for _ in range(1 + (r[0] % 11 == 0)))
        return len(query.recentProgress)

    days = 1 + max(int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() + 86399) // (8 * 86400) for r in rows) - int((t0 - dt.datetime(1970, 1, 1)).total_seconds()) // (8 * 86400)
    assert days - 1 <= read("one_file") - 1 <= days
    assert read("many_files", FILE_ROWS=100) > days + 3
    assert read("files_together", FILES_ONE_BY_ONE=3) < 6


def test_stream_average_takes_repeated_rows_one_after_the_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live.EmaState, "PIECE", 16)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=5 * (i // 3)), 1, "ab"[i % 2], None if i % 29 == 0 else float(i * 7 % 13), None) for i in range(400) for _ in range(1 + (i % 5 == 0))]
    got = models.QUERIES["stream_average"](spark, write_events(spark, tmp_path / "t", rows, 3)).collect()
    for s in "ab":
        want = sorted((r[1], r[4]) for r in rows if r[3] == s and r[4] is not None)
        ema = pd.Series([c for _, c in want]).ewm(span=9, adjust=False).mean()
        mine, theirs = sorted((r.ts, r.ema_9) for r in got if r.symbol == s), sorted(zip((t for t, _ in want), ema))
        assert [t for t, _ in mine] == [t for t, _ in theirs]
        assert [e for _, e in mine] == pytest.approx([e for _, e in theirs], abs=1e-5)

"""Bars and exponential averages over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tickloom.config import TS, timeframe_seconds


def read_ticks(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def instant(ts: str) -> Column:
    """Zone-free time read as UTC: watermarks need an instant, whatever the session zone."""
    seconds = f"CAST(CAST({ts} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS BIGINT)"
    return F.expr(f"timestamp_micros({seconds} * 1000000 + CAST(extract(SECOND FROM {ts}) % 1 * 1000000 AS BIGINT))")


def wall_clock(ts: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + unix_micros({ts}) * INTERVAL '0.000001' SECOND")


def stream_bars(ticks: DataFrame, timeframe: str, late: str = "10 minutes", ties: Sequence[str] = ()) -> DataFrame:
    """Closed bars from ``symbol, ts, price, size``; in append mode a bar appears once it can no
    longer change. Ticks later than ``late`` are dropped. State is one partial row per open bar.
    """
    seconds = timeframe_seconds(timeframe)
    at = F.struct(TS, *ties) if ties else F.col(TS)
    if ticks.schema[TS].dataType.typeName() == "timestamp_ntz":
        ticks = ticks.withColumn(TS, instant(TS))
    return (
        ticks.withWatermark(TS, late)
        .groupBy("symbol", F.window(TS, f"{seconds} seconds").alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), wall_clock("w.start").alias(TS), "open", "high", "low", "close", "volume")
    )


def replay_bars(ticks: DataFrame, timeframe: str, path: str, late: str = "10 minutes", ties: Sequence[str] = ()) -> DataFrame:
    """Run a tick stream over all input there is, into files under ``path``, and read the bars."""
    out = stream_bars(ticks, timeframe, late, ties)
    run = out.writeStream.format("parquet").option("path", f"{path}/bars").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return ticks.sparkSession.read.schema(out.schema).parquet(f"{path}/bars")


#: A waiting row, and the name of a piece of them: its first row and its number.
ROW = np.dtype([("us", "<i8"), ("close", "<f8")])
NAMED = np.dtype([*ROW.descr, ("number", "<i8")])


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["close"], rows["us"]))]


def rows_before(rows: np.ndarray, us: int, close: float | None = None) -> int:
    """How many of the ordered rows come before a time, or before a row of that time and close."""
    start = np.searchsorted(rows["us"], us)
    return int(start if close is None else start + np.searchsorted(rows["close"][start : np.searchsorted(rows["us"], us, "right")], close))


def next_number(named: np.ndarray) -> int:
    return int(named["number"].max()) + 1 if len(named) else 0


def packed(frames: Iterator[pd.DataFrame], most: int) -> Iterator[np.ndarray]:
    """Rows of frames, joined until there are ``most`` of them."""
    run = []
    for pdf in frames:
        if len(pdf):
            run.append(np.empty(len(pdf), ROW))
            run[-1]["us"], run[-1]["close"] = pdf["us"].astype("int64"), pdf["close"]  # a missing time raises
        if sum(map(len, run)) >= most:
            yield np.concatenate(run)
            run = []
    if run:
        yield np.concatenate(run)


class EmaState(StatefulProcessor):
    """Exponential averages of one series, from rows that may arrive in any order within the watermark.

    Rows wait until the watermark passes their time; a timer then releases them in order, each folded into the last values. What waits is
    held as sorted pieces of ``PIECE`` rows packed as bytes, so the state is asked once a piece, not once a row. ``index`` names each piece with its
    first row: a release reads only pieces that begin before the watermark, merges those that overlap and puts back what they hold after it.
    So a row is read about once however many batches it waits for. A task sorts ``RUN`` pieces of a batch at a time and holds no more.
    """

    PIECE = 10_000
    RUN = 100

    def __init__(self, alphas: dict[str, float]):
        self.alphas = alphas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"{n} double" for n in self.alphas))
        self.index = handle.getValueState("index", "pieces binary")
        self.pieces = handle.getMapState("pieces", "number long", "rows binary")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def _named(self) -> np.ndarray:
        """The waiting pieces in order of their first rows."""
        found = self.index.get() if self.index.exists() else None
        return np.frombuffer(bytes(found[0]), NAMED) if found is not None else np.empty(0, NAMED)

    def _name(self, named: np.ndarray) -> None:
        if len(named):
            self.index.update((in_order(named).tobytes(),))
        else:
            self.index.clear()

    def _store(self, rows: np.ndarray, number: int) -> np.ndarray:
        """Keep ordered rows as pieces with the numbers from ``number`` on."""
        named = []
        for at in range(0, len(rows), self.PIECE):
            piece = rows[at : at + self.PIECE]
            self.pieces.updateValue((number + len(named),), (piece.tobytes(),))
            named.append((piece["us"][0], piece["close"][0], number + len(named)))
        return np.array(named, NAMED)

    def _take(self, number: int) -> np.ndarray:
        rows = np.frombuffer(bytes(self.pieces.getValue((number,))[0]), ROW)
        self.pieces.removeKey((number,))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named, firsts = self._named(), []
        for run in packed(rows, self.RUN * self.PIECE):
            new = self._store(in_order(run), next_number(named))
            named = np.concatenate([named, new])
            firsts.append(int(new["us"][0]))
        if firsts:
            self._name(named)
            self._wake(min(firsts))
        return iter(())

    def _release(self, named: np.ndarray, mark: int) -> Iterator[np.ndarray]:
        """Rows before ``mark`` in order, taken out of the state; a part ends before the first row of the next piece that is not read yet."""
        due = named[: np.searchsorted(named["us"], mark)]
        held, left = np.empty(0, ROW), 0
        for i, piece in enumerate(due):
            held = np.concatenate([held, self._take(int(piece["number"]))])
            ended = i + 1 == len(due)
            if ended or len(held) >= 2 * left + self.PIECE:
                held = in_order(held)
                cut = rows_before(held, mark) if ended else rows_before(held, due["us"][i + 1], due["close"][i + 1])
                yield held[:cut]
                held, left = held[cut:], len(held) - cut
        rest = np.concatenate([named[len(due) :], self._store(held, next_number(named))])
        self._name(rest)
        if len(rest):
            self._wake(int(rest["us"].min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        named = self._named()
        if not len(named) or named["us"][0] >= mark:
            return
        values = list(self.last.get()) if self.last.exists() else None
        for ready in self._release(named, mark):
            for at in range(0, len(ready), self.PIECE):
                piece = ready[at : at + self.PIECE]
                out = {"symbol": [key[0]] * len(piece), "us": piece["us"], "close": piece["close"]}
                for i, (name, alpha) in enumerate(self.alphas.items()):
                    before = [] if values is None else [values[i]]
                    out[name] = pd.Series(np.concatenate([before, piece["close"]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(before) :]
                values = [float(out[n][-1]) for n in self.alphas]
                yield pd.DataFrame(out)
        self.last.update(tuple(values))

    def close(self) -> None:
        pass


def stream_ema(bars: DataFrame, spans: dict[str, int], late: str = "10 minutes") -> DataFrame:
    """Running averages of ``symbol, ts, close`` rows in order of time (then close), one output row per row once the watermark has passed it.

    Rows that come later than ``late`` are dropped; ``late_rows`` counts them. Rows without a close take no part.
    """
    alphas = {n: 2.0 / (s + 1) for n, s in spans.items()}
    plain = bars.schema[TS].dataType.typeName() == "timestamp_ntz"
    rows = (bars.withColumn(TS, instant(TS)) if plain else bars).filter("close IS NOT NULL").withWatermark(TS, late)
    rows = rows.select("symbol", TS, F.unix_micros(TS).alias("us"), "close")
    schema = "symbol string, us long, close double, " + ", ".join(f"{n} double" for n in alphas)
    out = rows.groupBy("symbol").transformWithStateInPandas(EmaState(alphas), schema, "Append", "EventTime")
    ts = F.timestamp_micros("us")
    return out.withColumn(TS, ts).select("symbol", (wall_clock(TS) if plain else F.col(TS)).alias(TS), "close", *alphas)


def late_rows(query) -> int:
    """Rows that a query has dropped because they came after the watermark, over the batches whose progress it still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

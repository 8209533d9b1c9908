"""Bar table kept up to date from a stream of price snapshots: the newest snapshot of a bar wins.

State holds the newest snapshot of each open bar until the watermark passes the bar's end, so late and repeated
snapshots are settled there. A batch hands over the bars it touched; they are merged with the open bars only, whose
number follows the series and the lateness, not the history. Bars that can no longer change move to the folder of their day once.

Files of a batch become visible when its manifest is renamed into place. A repeated batch finds its manifest and does
nothing, or writes the same folder again. A day's folders are joined when there are more than ``most``; what no manifest names is deleted
one batch later, so readers that hold the last manifest still find their files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import TS, timeframe_seconds
from tickloom.operators.clean import append_sources
from tickloom.operators.series import epoch_seconds
from tickloom.streaming.bars import instant, wall_clock

SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, seen timestamp, open double, high double, low double, close double, volume double"

#: Bytes a file should have.
FILE_BYTES = 128 << 20


class BarStore:
    """Folders of bar files under a path, and the manifests that name those in use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def bytes_in(self, folder: str) -> int:
        return self.fs.getContentSummary(self._at(folder)).getLength()

    def delete(self, folder: str) -> None:
        self.fs.delete(self._at(folder), True)

    def manifests(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("manifest") if n.endswith(".json")]

    def manifest(self) -> dict:
        """The newest manifest; an empty one if there is none."""
        numbers = self.manifests()
        if not numbers:
            return {"high": None, "open": [], "closed": {}, "unused": []}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{numbers[-1]:012d}.json").collect()))

    def switch(self, number: int, manifest: dict) -> None:
        """Make a manifest the newest one in one step."""
        draft, place = self._at(f"draft/{number:012d}.json"), self._at(f"manifest/{number:012d}.json")
        self.fs.mkdirs(place.getParent())
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not self.fs.rename(draft, place) and not self.fs.exists(place):
            raise OSError(f"could not rename {draft} to {place}")
        for old in self.manifests()[:-2]:
            self.delete(f"manifest/{old:012d}.json")

    def read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])


def folders_of(manifest: dict) -> set[str]:
    return {*manifest["open"], *(f for day in manifest["closed"].values() for f in day)}


def newest_snapshots(snapshots: DataFrame, timeframe: str, late: str) -> DataFrame:
    """The newest of ``symbol, ts, last_price`` for each open bar that a batch touches, as a flat bar; of equal times the larger price."""
    if snapshots.schema[TS].dataType.typeName() == "timestamp_ntz":
        snapshots = snapshots.withColumn(TS, instant(TS))
    last = snapshots.withWatermark(TS, late).groupBy("symbol", F.window(TS, f"{timeframe_seconds(timeframe)} seconds").alias("w")).agg(F.max(F.struct(TS, "last_price")).alias("n"))
    flat = [F.col("n.last_price").alias(c) for c in ("open", "high", "low", "close")]
    return last.select("symbol", F.lit(timeframe).alias("timeframe"), wall_clock("w.start").alias(TS), F.col(f"n.{TS}").alias("seen"), *flat, F.lit(0.0).alias("volume"))


def merge_batch(batch: DataFrame, number: int, path: str, timeframe: str, late_millis: int, most: int = 8) -> None:
    """Merge one batch of newest snapshots into the table."""
    store = BarStore(batch.sparkSession, path)
    if number in store.manifests():
        return
    old, own = store.manifest(), f"batch={number}"
    touched = f"update={number}"
    batch.write.mode("overwrite").parquet(f"{path}/{touched}")
    files = 1 + sum(map(store.bytes_in, [touched, *old["open"]])) // FILE_BYTES
    bars = append_sources([store.read(old["open"]), store.read([touched])], "last", within=["seen", "close"])
    # Spark drops what is later than the watermark of the batches before; such bars are closed.
    mark = None if old["high"] is None else old["high"] // 1000 - late_millis
    closed = F.lit(False) if mark is None else (epoch_seconds(TS) + timeframe_seconds(timeframe)) * 1000 <= mark
    day = F.when(closed, F.date_format(TS, "yyyy-MM-dd")).otherwise("open")
    bars.withColumn("day", day).repartition(files, "day", "symbol").write.mode("overwrite").partitionBy("day").parquet(f"{path}/{own}")
    days = [n[4:] for n in store.names(own) if n.startswith("day=")]
    new = {"open": [f"{own}/day=open"] if "open" in days else [], "closed": {d: list(f) for d, f in old["closed"].items()}}
    for d in days:
        if d == "open":
            continue
        folders = [*new["closed"].get(d, []), f"{own}/day={d}"]
        if len(folders) > most:
            files = max(1, sum(map(store.bytes_in, folders)) // FILE_BYTES)
            store.read(folders).coalesce(files).write.mode("overwrite").parquet(f"{path}/{own}/joined={d}")
            folders = [f"{own}/joined={d}"]
        new["closed"][d] = folders
    written = [f"{own}/day={d}" for d in days]
    high = store.read(written).agg(F.max(F.unix_micros("seen"))).first()[0] if written else None
    new["high"] = max((h for h in (high, old["high"]) if h is not None), default=None)
    new["unused"] = sorted((folders_of(old) | set(written)) - folders_of(new))
    store.switch(number, new)
    store.delete(touched)
    for folder in old["unused"]:
        store.delete(folder)
    for folder in {f.split("/")[0] for f in old["unused"]}:  # a batch of which no folder is left
        if not any("=" in n for n in store.names(folder)):
            store.delete(folder)


def upsert_latest(snapshots: DataFrame, timeframe: str, path: str, checkpoint: str, late: str = "10 minutes", most: int = 8):
    """Keep, per series and bar, the newest snapshot in the bar table at ``path``; snapshots later than ``late`` are dropped."""
    millis = snapshots.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {late})").first()[0]

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, timeframe, millis, most)

    return newest_snapshots(snapshots, timeframe, late).writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The bars of the newest manifest, open ones included."""
    store = BarStore(spark, path)
    return store.read(sorted(folders_of(store.manifest()))).drop("seen")

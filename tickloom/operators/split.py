"""Time-ordered and hashed splits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import TS
from tickloom.operators.series import positions, time_bucket
from tickloom.session import cut_lineage

ROW = "_order"
SEGMENT = "_segment"


def ordered(df: DataFrame, order: str = TS, ties: Sequence[str] = ("symbol",), slots: int = 64) -> DataFrame:
    """Add each row's position in the whole table by time, and the table's row count.

    A bucket covers ``slots`` bars of every series, so its size follows the number of series.
    """
    out = positions(df, [], order, name=ROW, ties=ties, bucket=time_bucket(df, order, slots))
    return out.withColumn("_rows", df.agg(F.count(F.lit(1))).scalar())


def chronological(df: DataFrame, train: float = 0.7, validation: float = 0.15, order: str = TS, ties: Sequence[str] = ("symbol",)) -> DataFrame:
    """Label rows train, validation or test in time order; boundaries are whole rows, rounded down."""
    out = ordered(df, order, ties)
    first = F.floor(F.col("_rows") * F.lit(train))
    second = F.floor(F.col("_rows") * F.lit(train + validation))
    return out.withColumn("split", F.when(F.col(ROW) < first, "train").when(F.col(ROW) < second, "validation").otherwise("test")).drop(ROW, "_rows")


def time_folds(df: DataFrame, folds: int = 5, gap: int = 0, test_rows: int | None = None, order: str = TS, ties: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per (row, fold) it takes part in, with its role.

    Training expands from the first row up to ``gap`` rows before each test block; test blocks are
    the last ``folds`` blocks of equal size.
    """
    out = ordered(df, order, ties)
    size = F.lit(test_rows) if test_rows else F.floor(F.col("_rows") / (folds + 1))
    roles = []
    for k in range(folds):
        start = F.col("_rows") - size * (folds - k)
        role = F.when((F.col(ROW) >= start) & (F.col(ROW) < start + size), "test").when(F.col(ROW) < start - gap, "train")
        roles.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    fanned = out.select("*", F.explode(F.array(*roles)).alias("_f")).filter(F.col("_f.role").isNotNull())
    return fanned.select(*df.columns, "_f.fold", "_f.role")


def _hashed(key: Sequence[str], seed: int) -> Column:
    """A number below 2^32 from the md5 of the key's text and the seed, so that any engine can name a row's fold."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hashed_folds(df: DataFrame, folds: int = 5, key: Sequence[str] = ("symbol", TS), seed: int = 42) -> DataFrame:
    """Shuffled folds: the same row falls into the same fold on every run."""
    return df.withColumn("fold", (_hashed(key, seed) % folds).cast("int"))


def hashed_split(df: DataFrame, test: float = 0.2, key: Sequence[str] = ("symbol", TS), seed: int = 42) -> DataFrame:
    share = (_hashed(key, seed) % 1_000_000) / 1_000_000.0
    return df.withColumn("split", F.when(share < test, "test").otherwise("train"))


def walk_forward(df: DataFrame, initial: float = 0.5, steps: int = 5, step_rows: int | None = None, order: str = TS, ties: Sequence[str] = ("symbol",)) -> DataFrame:
    """Like ``time_folds`` with a first training share and steps that follow it directly."""
    out = ordered(df, order, ties)
    start = F.floor(F.col("_rows") * F.lit(initial))
    size = F.lit(step_rows) if step_rows else F.greatest(F.floor((F.col("_rows") - start) / steps), F.lit(1))
    roles = []
    for k in range(steps):
        at = start + size * k
        role = F.when(F.col(ROW) < at, "train").when(F.col(ROW) < at + size, "test")
        roles.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    fanned = out.select("*", F.explode(F.array(*roles)).alias("_f")).filter(F.col("_f.role").isNotNull())
    return fanned.select(*df.columns, "_f.fold", "_f.role")


# --- folds without copies ----------------------------------------------------------------------
@dataclass
class Folds:
    """Rows with a segment number each, and for every fold the segments it trains on and is tested on.

    Folds that share rows share segments, so the table holds each row once and is stored once.
    """

    rows: DataFrame
    roles: dict[int, tuple[tuple[int, ...], tuple[int, ...]]]
    stored: bool = False

    def part(self, segments: Sequence[int]) -> DataFrame:
        return self.rows.filter(F.col(SEGMENT).isin(*segments)).drop(SEGMENT)

    def train(self, fold: int) -> DataFrame:
        return self.part(self.roles[fold][0])

    def test(self, fold: int) -> DataFrame:
        return self.part(self.roles[fold][1])

    def kept(self) -> Folds:
        """The same folds over rows written once."""
        return self if self.stored else Folds(cut_lineage(self.rows), self.roles, True)


def _between(out: DataFrame, columns: Sequence[str], rows: int, bounds: Iterable[tuple[int, int, int]]) -> Folds:
    """Folds that train on the rows before the first bound and are tested from the second to the third."""
    bounds = [tuple(min(max(b, 0), rows) for b in fold) for fold in bounds]
    edges = sorted({0, *(b for fold in bounds for b in fold)})
    segment = F.lit(-1)
    for e in edges:
        segment = segment + (F.col(ROW) >= e).cast("int")
    inside = lambda a, b: tuple(i for i, e in enumerate(edges) if a <= e < b)
    return Folds(out.select(*columns, segment.alias(SEGMENT)), {k: (inside(0, train), inside(start, stop)) for k, (train, start, stop) in enumerate(bounds)})


def time_segments(df: DataFrame, folds: int = 5, gap: int = 0, test_rows: int | None = None, order: str = TS, ties: Sequence[str] = ("symbol",)) -> Folds:
    """The folds of ``time_folds``, each row once."""
    out, rows = ordered(df, order, ties), df.count()
    size = test_rows or rows // (folds + 1)
    starts = [rows - size * (folds - k) for k in range(folds)]
    return _between(out, df.columns, rows, [(s - gap, s, s + size) for s in starts])


def walk_segments(df: DataFrame, initial: float = 0.5, steps: int = 5, step_rows: int | None = None, order: str = TS, ties: Sequence[str] = ("symbol",)) -> Folds:
    """The folds of ``walk_forward``, each row once."""
    out, rows = ordered(df, order, ties), df.count()
    start = int(rows * initial)
    size = step_rows or max((rows - start) // steps, 1)
    return _between(out, df.columns, rows, [(start + size * k, start + size * k, start + size * (k + 1)) for k in range(steps)])


def hashed_segments(df: DataFrame, folds: int = 5, key: Sequence[str] = ("symbol", TS), seed: int = 42) -> Folds:
    """Test on each of the ``hashed_folds`` and train on the others, each row once."""
    rows = df.withColumn(SEGMENT, (_hashed(key, seed) % folds).cast("int"))
    return Folds(rows, {k: (tuple(i for i in range(folds) if i != k), (k,)) for k in range(folds)})


def as_folds(folded: DataFrame | Folds) -> Folds:
    """Folds from rows that name their fold and role themselves."""
    if isinstance(folded, Folds):
        return folded
    rows = folded.withColumn(SEGMENT, (F.col("fold") * 2 + (F.col("role") == "test").cast("int")).cast("int"))
    kept = cut_lineage(rows)
    numbers = sorted(r["fold"] for r in kept.select("fold").distinct().collect())
    return Folds(kept, {k: ((2 * k,), (2 * k + 1,)) for k in numbers}, True)

"""Shared by the document operators: Arrow row maps, word caches, row keys and stored intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.session import shared_folder

#: Rows and bytes of text that one call of a row function gets at most; a single longer row is passed alone.
PIECE_ROWS, PIECE_BYTES = 2000, 4 << 20

#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 600_000


_FORGET: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Name what empties a module's memories of words."""
    _FORGET[module] = forget


def enter(module: str) -> None:
    """At the start of a task: workers outlive tasks, so the memories of other operators are emptied."""
    for name, forget in _FORGET.items():
        if name != module:
            forget()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold a bounded number of rows and bytes of the given column."""
    sizes, start, held = batch.column(column), 0, 0
    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (held + n > PIECE_BYTES or i - start >= PIECE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], text: str = "text") -> DataFrame:
    """Apply a function of columns (dict of lists) to all rows of ``df`` piece by piece.

    ``make`` is called once for each task and returns the function; its result needs not have as many rows
    as its input.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at, arrow = df.columns.index(text), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(make.__module__)
        work = make()
        for batch in batches:
            for part in pieces(batch, at):
                got = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


class WordCache(dict):
    """Remembers ``make(key)``; empties itself when it holds too many keys, so its memory is bounded."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def held_out(doc_id: Column) -> Column:
    """True for the documents kept out of every fit: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts and labels of at most ``rows`` training rows, the first by a hash of the id.

    The chosen ids are at most ``rows``, which bounds the broadcast. Held-out rows and rows without a
    label are no training rows; a document labelled twice counts once, with its larger label.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two words that tell rows apart by id and whole text; equal rows share them, nulls are values of their own."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(1), doc_id, text.isNull(), body).alias("k1"), F.xxhash64(F.lit(2), body, text.isNull(), doc_id).alias("k2")]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there, so no lost executor brings back the work before it."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

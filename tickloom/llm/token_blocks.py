"""Token ids as patched frame-of-reference blocks.

A segment holds the ids of some documents in blocks of 128. A block stores its minimum and packs the differences at the
width that covers 90 % of them; the high bits of the others go to the block's exception list. Index arrays hold where each
block's packed bits and exceptions start, so any range of ids is read without the rest.

Bytes of a segment, little endian: "PFB1", u32 blocks, u64 ids; then by block u32 minimum, u8 width, u32 start in the
packed words (and the end), u32 start in the exceptions (and the end); then by exception u8 place, u32 high bits; then
the packed u64 words.

Segments are rows of Parquet files, so that Spark's committer makes a whole and unrepeated set of files on any store even if tasks
are run again. Rows hold the file's number in the order of ids, the ids before the segment in its file, and doc_ids and
lengths of its documents.

Null texts count as empty; every document ends with an end id, so an empty one has length 1. Documents with one doc_id are
ordered by a hash of their text, equal rows stay apart. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.llm.bpe_automaton import byte_letters
from tickloom.llm.common import enter, map_texts, pieces, remembers
from tickloom.llm.tokens import TextEncoder
from tickloom.session import shared_folder

VOCABULARY = path("byte_bpe_50k.json")
BLOCK, COVERED, MAGIC = 128, 0.9, b"PFB1"

#: A space and letters that are letters in every version of Unicode: one word of the pre-split pattern.
_WORD = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u0527]+").fullmatch

#: Ids after which a segment ends with the document.
SEGMENT_IDS = 1 << 20

SEGMENTS = "part int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, blocks binary"


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values of ``width`` bits as rows of 64-bit words."""
    values = np.ascontiguousarray(low.T).astype(np.uint64)
    out = np.zeros((BLOCK * width // 64, low.shape[0]), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        out[word] |= values[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= values[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out, mask = np.empty((BLOCK, words.shape[0]), np.uint64), np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        out[j] = columns[word] >> np.uint64(bit)
        if bit + width > 64:
            out[j] |= columns[word + 1] << np.uint64(64 - bit)
        out[j] &= mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> bytes:
    """One segment; ``ids`` are unsigned 32-bit numbers."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits of each difference
    width = np.partition(need, int(np.ceil(COVERED * BLOCK)) - 1, axis=1)[:, int(np.ceil(COVERED * BLOCK)) - 1] if blocks else np.zeros(0, np.uint8)
    over = need > width[:, None]
    at = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 64))])
    packed = np.zeros(at[-1], np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        places = at[chosen][:, None] + np.arange(w * BLOCK // 64)
        packed[places] = _packed(rest[chosen] & np.uint32((1 << w) - 1), w)
    patched = np.concatenate([[0], np.cumsum(over.sum(axis=1))])
    where = np.nonzero(over)
    high = (rest[where].astype(np.uint64) >> width[where[0]].astype(np.uint64)).astype("<u4")
    head = MAGIC + np.array([blocks], "<u4").tobytes() + np.array([n], "<u8").tobytes()
    return head + b"".join(x.tobytes() for x in (low.astype("<u4"), width, at.astype("<u4"), patched.astype("<u4"), where[1].astype(np.uint8), high, packed.astype("<u8")))


def decode_blocks(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of a segment from ``start`` to ``stop``; only blocks that hold them are unpacked."""
    if data[:4] != MAGIC:
        raise ValueError("no segment of token blocks")
    blocks, n = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0])
    place, parts = 16, []
    for kind, count in (("<u4", blocks), ("u1", blocks), ("<u4", blocks + 1), ("<u4", blocks + 1)):
        parts.append(np.frombuffer(data, kind, count, place))
        place += parts[-1].nbytes
    low, width, at, patched = parts
    patches, words = int(patched[-1]), place + 5 * int(patched[-1])
    stop = n if stop is None else min(stop, n)
    first, last = start // BLOCK, -(-stop // BLOCK)
    if stop <= start:
        return np.zeros(0, np.uint32)
    out = np.zeros((last - first, BLOCK), np.uint64)
    packed = np.frombuffer(data, "<u8", int(at[last] - at[first]), words + 8 * int(at[first]))
    for w in np.unique(width[first:last]).tolist():
        if w:
            chosen = np.flatnonzero(width[first:last] == w)
            places = (at[first:last][chosen].astype(np.int64) - int(at[first]))[:, None] + np.arange(w * BLOCK // 64)
            out[chosen] = _unpacked(packed[places], w)
    a, b = int(patched[first]), int(patched[last])
    owner = np.repeat(np.arange(last - first), np.diff(patched[first : last + 1].astype(np.int64)))
    spot = np.frombuffer(data, "u1", b - a, place + a)
    out[owner, spot] |= np.frombuffer(data, "<u4", b - a, place + patches + 4 * a).astype(np.uint64) << width[first:last][owner].astype(np.uint64)
    out += low[first:last, None]
    return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK].astype(np.uint32)


@lru_cache(2)
def library_encoder(vocabulary: str) -> TextEncoder:
    """Encodes unknown words with the tokenizers library: words of letters by its model, as nothing is left to split, others many joined in one
    call; token lengths tell them apart."""
    from tokenizers import Tokenizer

    library, letters = Tokenizer.from_file(vocabulary), byte_letters()
    with open(vocabulary, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    size = np.zeros(library.get_vocab_size(), np.int64)
    for token, i in library.get_vocab(with_added_tokens=False).items():
        size[i] = sum(c in letters for c in token)

    model, written = library.model, {b: c for c, b in letters.items()}
    packed = [i.tobytes() for i in np.arange(len(size), dtype="<u4")]

    def word(text: str) -> bytes:
        return b"".join([packed[t.id] for t in model.tokenize(text.encode().decode("latin-1").translate(written))])

    def encode(texts: list[str]) -> list[bytes]:
        if not all(t[0] == " " and not t[-1].isspace() for t in texts):  # joined, these would meet
            return [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        out: list[bytes] = []
        for i in range(0, len(texts), 1000):
            some = texts[i : i + 1000]
            ids = np.array(library.encode("".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(t.encode()) for t in some])) + 1
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def encode_pieces(texts: list[str]) -> list[bytes]:
        out = [word(t) if _WORD(t) else None for t in texts]
        rest = iter(encode_others([t for t, b in zip(texts, out, strict=True) if b is None]))
        return [next(rest) if b is None else b for b in out]

    def encode_others(texts: list[str]) -> list[bytes]:
        joined = [t[0] == " " and not t[-1].isspace() for t in texts]
        one, many = iter(encode([t for t, j in zip(texts, joined, strict=True) if not j])), iter(encode([t for t, j in zip(texts, joined, strict=True) if j]))
        return [next(many if j else one) for j in joined]

    return TextEncoder(encode_pieces, {s: np.array([i], "<u4").tobytes() for s, i in special.items()})


remembers(__name__, library_encoder.cache_clear)


def segments(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """Segments (columns SEGMENTS) of all whole texts in ascending order of doc_id, each text followed by ``end_id``."""
    arrow, end = to_arrow_schema(T.StructType.fromDDL(SEGMENTS)), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        encoder, part, before = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids, data = [], []

        def row() -> pa.RecordBatch:
            nonlocal before, doc_ids, data
            ids = np.frombuffer(b"".join(data), "<u4")
            values = [[part], [before], [len(ids)], [doc_ids], [[len(d) // 4 for d in data]], [encode_blocks(ids)]]
            before, doc_ids, data = before + len(ids), [], []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        held = 0
        for batch in batches:
            for piece in pieces(batch, 1):
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                    doc_ids.append(doc_id)
                    data.append(ids + end)
                    held += len(data[-1]) // 4
                    if held >= SEGMENT_IDS:
                        yield row()
                        held = 0
        if doc_ids:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, SEGMENTS)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = 0) -> None:
    segments(docs, vocabulary, end_id).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (array of int) of each document, start being the ids of all documents before it."""

    def make():
        def work(cols):
            out = {"part": [], "doc_id": [], "local": [], "ids": []}
            for part, before, doc_ids, lengths, blocks in zip(*(cols[c] for c in ("part", "before", "doc_ids", "lengths", "blocks")), strict=True):
                ids, ends = decode_blocks(blocks), np.cumsum(lengths)
                out["part"] += [part] * len(doc_ids)
                out["doc_id"] += doc_ids
                out["local"] += (before + ends - lengths).tolist()
                out["ids"] += np.split(ids.astype("i4"), ends[:-1])
            return out

        return work

    return _with_starts(spark, folder, make, "ids array<int>")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) of each document in the files."""

    def make():
        def work(cols):
            out = {"part": [], "doc_id": [], "local": [], "n_tokens": [], "ids_crc32": []}
            for part, before, doc_ids, lengths, blocks in zip(*(cols[c] for c in ("part", "before", "doc_ids", "lengths", "blocks")), strict=True):
                data, ends = memoryview(decode_blocks(blocks).astype("<u4").tobytes()), np.cumsum(lengths).tolist()
                out["part"] += [part] * len(doc_ids)
                out["doc_id"] += doc_ids
                out["local"] += [before + e - n for e, n in zip(ends, lengths, strict=True)]
                out["n_tokens"] += lengths
                out["ids_crc32"] += [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths, strict=True)]
            return out

        return work

    return _with_starts(spark, folder, make, "n_tokens bigint, ids_crc32 bigint")


def _with_starts(spark: SparkSession, folder: str, make, columns: str) -> DataFrame:
    """Each file adds the ids of the files before it; there is one row a file in that sum."""
    files = spark.read.schema(SEGMENTS).parquet(folder)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    rows = map_texts(files, f"part int, doc_id bigint, local bigint, {columns}", make, "blocks")
    names = [c.split(" ")[0] for c in columns.split(", ")]
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), *names)


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return their index."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_token_files(docs, folder, vocabulary)
    return token_index(spark, folder)

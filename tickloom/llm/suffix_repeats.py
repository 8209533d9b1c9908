"""Exact removal of text that is repeated anywhere: two-stage suffix sorting of the places where repeats can be.

Every string of LENGTH bytes belongs to one anchor: of the GRAM-byte strings in it, the one with the least hash, the first of equals. Equal strings
have equal anchors at equal places, so repeats are found anchor by anchor. Per anchor, a document has one stretch of strings that belong to it
(a segment). Anchors met once are dropped. If all segments of an anchor are the same bytes, all of their strings are repeats. Else
the different segments are put side by side and their suffixes sorted in two stages: those smaller than their successors directly, by up to LENGTH bytes; the
others are induced from these by scanning the buckets of first bytes in order. A string is repeated if the common prefix with a
neighbour in that order is LENGTH or more, or if its segment occurs twice.

Anchors with more than TOGETHER different segments, which one task should not hold, are dealt out string by string: equal strings are counted
by a 128-bit hash. Removal is judged on the input: repeats removed
in one document still count for others. Null texts are empty; nothing is removed from texts shorter than LENGTH bytes; equal rows count as
two places. Bytes that are cut inside a character are kept as they are in the digests; the text column drops the broken characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.llm.common import map_texts, pieces, stored

LENGTH, GRAM = 200, 64

#: Different segments of one anchor that are sorted together, and bytes after which a task sorts what it has.
TOGETHER, SORTED_BYTES = 3000, 400_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i below n, modulo 2 ** 64."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[base] = have
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What the hash of any stretch is taken from."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Well spread hashes of the bytes from start to end, the same wherever these bytes stand."""
    return _mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last string of each segment, its anchor's place and hash, and the segment's hash."""
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums = prefix_sums(data)
    grams = n + width - 1
    own = _mixed((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, grams))
    bits = np.uint64(max(1, int(grams).bit_length()))
    value = (own >> bits << bits) | np.arange(grams, dtype=np.uint64)  # hash, then place
    blocks = -(-grams // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max)
    grid[:grams] = value
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    at = place[first]
    return first, last, at, own[at], hashes(sums, first, last + length)


def two_stage_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes at least."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    step = np.sign(np.diff(data.astype(np.int16), append=np.int16(-1)))  # to the successor; the end is smaller than any byte
    known = np.flatnonzero(step)
    rising = step[known[np.searchsorted(known, np.arange(n))]] > 0
    text, direct = data.tobytes(), np.flatnonzero(rising).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    ends = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))  # its successor is the empty suffix
    out = []
    for c in range(256):
        falling = []
        queue = waiting[c]
        while queue:  # falling suffixes of this bucket come before the rising ones; each may induce its predecessor in the bucket
            found = np.concatenate(queue)
            falling.append(found)
            before = found[found > 0] - 1
            queue = [same] if len(same := before[(data[before] == c) & ~rising[before]]) else []
        bucket = np.concatenate([*falling, direct[ends[c] : ends[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > c]
        symbols = data[before]
        order = np.argsort(symbols, kind="stable")
        cuts = np.flatnonzero(np.diff(symbols[order])) + 1
        for part in np.split(before[order], cuts) if len(before) else []:
            waiting[data[part[0]]].append(part)
    return np.concatenate(out)


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its strings (by start) also start elsewhere in the segments."""
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    is_start = np.zeros(len(data) + 1, np.int64)
    is_start[begin] += 1
    np.subtract.at(is_start, begin + sizes - length + 1, 1)
    order = two_stage_order(data, length)
    order = order[np.cumsum(is_start)[:-1][order] > 0]
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), bool)
    for i in range(0, len(a), 4096):
        left, right = (np.lib.stride_tricks.sliding_window_view(data, length)[x[i : i + 4096]] for x in (a, b))
        same[i : i + 4096] = (left == right).all(axis=1)  # the common prefix reaches the length
    hit = np.zeros(len(data), bool)
    hit[a[same]] = hit[b[same]] = True
    return [hit[s : s + n - length + 1] for s, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _packed(docs: DataFrame) -> DataFrame:
    """id, check and body (compressed UTF-8) of each row: rows with one id and check have the same text."""

    def make():
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return lambda cols: {"id": cols["id"], "check": cols["check"], "body": [squeeze((t or "").encode()) for t in cols["text"]]}

    return map_texts(docs.select(*_row(), "text"), "id bigint, check int, body binary", make)


def _row() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.hash("text").alias("check")]


def _all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, segment (hashes), id, check, first (of its strings) and more (strings after the first)."""

    def make():
        def work(cols):
            out = {k: [] for k in ("anchor", "segment", "id", "check", "first", "more")}
            for i, check, text in zip(cols["id"], cols["check"], cols["text"], strict=True):
                first, last, _, own, whole = anchors(np.frombuffer((text or "").encode(), np.uint8), length, gram)
                out["id"].append(np.full(len(first), i))
                out["check"].append(np.full(len(first), check))
                for k, v in (("anchor", own.view(np.int64)), ("segment", whole.view(np.int64)), ("first", first), ("more", last - first)):
                    out[k].append(v)
            return {k: np.concatenate(v) if v else [] for k, v in out.items()}

        return work

    return map_texts(docs.select(*_row(), "text"), "anchor bigint, segment bigint, id bigint, check int, first int, more int", make)


def _sorted_repeats(segments: DataFrame, length: int) -> DataFrame:
    """anchor, segment, start and stop of each run of repeated strings; ``segments`` has anchor, segment, times and body."""
    schema = T.StructType.fromDDL("anchor bigint, segment bigint, start int, stop int")
    arrow = to_arrow_schema(schema)

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[3] for r in rows], length)
        out = [(r[0], r[1], a, b) for r, hit in zip(rows, found, strict=True) for a, b in runs(hit | (r[2] > 1))]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != last and size >= SORTED_BYTES:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield judged(held)

    rows = segments.select("anchor", "segment", "times", "body").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, schema)


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and stop of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _counted_repeats(strings: DataFrame) -> DataFrame:
    """The same for anchors with very many segments; ``strings`` has anchor, segment, times, start and two hashes of each string."""
    often = strings.groupBy("anchor", "w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", "w1", "w2")
    return strings.join(often, ["anchor", "w1", "w2"]).select("anchor", "segment", "start", (F.col("start") + 1).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """id, check (of a row) and spans: byte ranges (start, stop) that repeated strings cover; ranges may overlap."""
    every = _all_segments(docs, length, gram)
    met = every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    shared = stored(every.join(met, "anchor"))
    # equal segments first become one row, so an anchor that is met very often has no more rows than different segments
    each = stored(shared.groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.min(F.struct("id", "check", "first", "more")).alias("at")))
    kinds = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("segment"))
    alike = kinds.filter("n = 1").select("anchor", "segment", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))
    some_large = not kinds.filter(F.col("n") > together).isEmpty()
    different = each.join(kinds.filter("n > 1").select("anchor", (F.col("n") > together).alias("large")), "anchor")
    wanted = different.groupBy(F.col("at.id").alias("id"), F.col("at.check").alias("check")).agg(
        F.collect_list(F.struct("anchor", "segment", "times", F.col("at.first").alias("first"), F.col("at.more").alias("more"), "large")).alias("wanted")
    )
    bodies = _packed(docs).join(wanted, ["id", "check"]).select("body", "wanted")

    def segments(large: bool):
        def make():
            expand = zstandard.ZstdDecompressor().decompress

            def work(cols):
                names = ("anchor", "segment", "times", "start", "w1", "w2") if large else ("anchor", "segment", "times", "body")
                out = {k: [] for k in names}
                for body, wanted in zip(cols["body"], cols["wanted"], strict=True):
                    text = expand(body)
                    sums = prefix_sums(np.frombuffer(text, np.uint8)) if large else None
                    for w in wanted:
                        if w["large"] is not large:
                            continue
                        if not large:
                            for k, v in zip(names, (w["anchor"], w["segment"], w["times"], text[w["first"] : w["first"] + w["more"] + length]), strict=True):
                                out[k].append(v)
                            continue
                        for start in range(w["more"] + 1):
                            own = hashlib.blake2b(text[w["first"] + start : w["first"] + start + length], digest_size=16).digest()
                            for k, v in zip(names, (w["anchor"], w["segment"], w["times"], start, int.from_bytes(own[:8], "little", signed=True), int.from_bytes(own[8:], "little", signed=True)), strict=True):
                                out[k].append(v)
                return out

            return work

        return make

    bodies = stored(bodies) if some_large else bodies
    small = map_texts(bodies, "anchor bigint, segment bigint, times bigint, body binary", segments(False), "body")
    found = _sorted_repeats(small, length)
    if some_large:
        strings = map_texts(bodies, "anchor bigint, segment bigint, times bigint, start int, w1 bigint, w2 bigint", segments(True), "body")
        found = found.union(_counted_repeats(strings))
    placed = shared.join(alike.union(found), ["anchor", "segment"])
    start = F.col("first") + F.coalesce("start", F.lit(0))
    stop = F.when(F.col("start").isNull(), F.col("first") + F.col("more")).otherwise(F.col("first") + F.col("stop") - 1) + length
    return placed.groupBy("id", "check").agg(F.collect_list(F.struct(start.alias("start"), stop.alias("stop"))).alias("spans"))


def covered(size: int, spans: list | None) -> np.ndarray:
    """Which of ``size`` bytes lie in a span."""
    edge = np.zeros(size + 1, np.int64)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.subtract.at(edge, [s["stop"] for s in spans], 1)
    return np.cumsum(edge[:-1]) > 0


def removal_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row."""
    joined = _packed(docs).join(repeated_spans(docs, length, gram, together), ["id", "check"], "left").select("id", "body", "spans")

    def make():
        expand = zstandard.ZstdDecompressor().decompress

        def work(cols):
            texts = [expand(b) for b in cols["body"]]
            gone = [covered(len(t), s) for t, s in zip(texts, cols["spans"], strict=True)]
            return {
                "doc_id": [None if i == -(1 << 63) else i for i in cols["id"]],
                "n_bytes": [len(t) for t in texts],
                "n_removed": [int(g.sum()) for g in gone],
                "n_spans": [len(runs(g)) for g in gone],
                "kept_sha256": [hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest() for t, g in zip(texts, gone, strict=True)],
            }

        return work

    return map_texts(joined, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", make, "body")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """All rows and columns of ``docs``, repeats removed from the text, which may become empty; n_chars, where there is such a column, is the new length.

    A row without repeats is unchanged.
    """
    names, text, schema = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text"), docs.schema
    spans = repeated_spans(docs, length, gram, together).select(F.col("id").alias("span_id"), F.col("check").alias("span_check"), "spans")
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *_row())
    joined = plain.join(spans, (F.col("id") == F.col("span_id")) & (F.col("check") == F.col("span_check")), "left").select(*names, "spans")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(schema["n_chars"].dataType, T.IntegralType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                columns = part.columns[:-1]
                texts = columns[text].to_pylist()
                lengths = columns[chars].to_pylist() if chars is not None else None
                for i, spans in enumerate(part.columns[-1].to_pylist()):
                    if spans:
                        body = np.frombuffer(texts[i].encode(), np.uint8)
                        texts[i] = body[~covered(len(body), spans)].tobytes().decode("utf-8", "ignore")
                        if lengths:
                            lengths[i] = len(texts[i])
                columns[text] = pa.array(texts, columns[text].type)
                if lengths:
                    columns[chars] = pa.array(lengths, columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(run, schema)

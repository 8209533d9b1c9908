"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every run of GRAM - 1 words of every test item is a seed, however many documents or items have it, so copies in the corpus can't displace the
seeds of an edited one: a copy with every fourth word changed still has some. A
document and an item that share a seed are aligned: the item against the words around all their seeds. The score is that of
the best local alignment over that of the whole item found word for word; THRESHOLD and more is a leak, so copies with words changed, added or left out count.
A common seed costs a count of the item's words around it: pairs too poor in them for any alignment of that score are not aligned.

Words are runs of non-spaces without the characters that are no letters, digits or underscores, in lower case. Items and documents of fewer than GRAM words
share nothing with any. Null texts are empty. Items with one id and different texts are aligned each; equal items count once, equal documents each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WordCache, map_texts, remembers, row_key, stored

GRAM, THRESHOLD = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

#: n-grams that one look-up table holds, counted as words of items; a benchmark with more is looked up in several passes over the documents.
TABLE_GRAMS = 2_000_000

_DROP = re.compile(r"\W+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: str) -> int:
    plain = _DROP.sub("", word.lower())
    return xxhash.xxh3_64_intdigest(plain.encode()) | 1 if plain else 0


_hashes = WordCache(_word_hash)
remembers(__name__, _hashes.clear)


def word_numbers(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.array(list(map(_hashes.__getitem__, text.split())), np.uint64)
    return out[out != 0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out + words[k : len(words) - n + 1 + k]) * _MULTIPLY
        out ^= out >> np.uint64(29)
    return out


def best_alignment(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Score of the best local alignment over the item's own, and the place of its last word in ``words``."""
    if not len(item) or not len(words):
        return 0.0, -1
    row, slope = np.zeros(len(words) + 1, np.int64), -GAP * np.arange(len(words) + 1)
    best, end = 0, -1
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope  # gaps in the item
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at - 1
    return best / (MATCH * len(item)), end


def can_leak(item: np.ndarray, words: np.ndarray, threshold: float) -> bool:
    """False only where no local alignment reaches ``threshold``: it has that share of the item's words at least, and no more words than mismatches and gaps leave room for."""
    need, reach = int(np.ceil(threshold * len(item) - 1e-9)), int(np.ceil((3 - 2 * threshold) * len(item)))
    known = np.cumsum(np.concatenate([[0], np.isin(words, item)]))
    return int((known[reach:] - known[:-reach]).max() if len(known) > reach else known[-1]) >= need


class Lookup:
    """Items by each of their n-grams."""

    def __init__(self, items: list[np.ndarray], n: int):
        self.n = n
        own = [np.unique(grams(w, n)) for w in items]
        every = np.concatenate([np.zeros(0, np.uint64), *own])
        order = np.argsort(every, kind="stable")
        self.table, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.holders = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in own])[order]
        self.ends = np.cumsum([0, *map(len, items)])
        self.words = np.concatenate([np.zeros(0, np.uint64), *items])
        self.mask = np.uint64((1 << max(20, int(16 * len(self.table)).bit_length())) - 1)

    def filter(self) -> np.ndarray:
        first = np.zeros(int(self.mask) + 1, bool)
        first[(self.table & self.mask).astype(np.int64)] = True
        return first

    def shared(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each item that shares an n-gram with ``words``, with the first and the last place of such n-grams."""
        own = grams(words, self.n)
        at = np.flatnonzero(first[(own & self.mask).astype(np.int64)])
        if not len(at):
            return
        slot = np.minimum(np.searchsorted(self.table, own[at]), len(self.table) - 1)
        same = self.table[slot] == own[at]
        at, slot = at[same], slot[same]
        counts = self.starts[slot + 1] - self.starts[slot]
        item = self.holders[np.repeat(self.starts[slot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        order = np.argsort(item, kind="stable")
        item, place = item[order], np.repeat(at, counts)[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        yield from zip(item[edges[:-1]].tolist(), place[edges[:-1]].tolist(), place[edges[1:] - 1].tolist(), strict=True)

    def item(self, k: int) -> np.ndarray:
        return self.words[self.ends[k] : self.ends[k + 1]]


def _aligned(docs: DataFrame, items: list[tuple[int, int, str]], threshold: float, n: int) -> DataFrame:
    """id, k1, k2, item, item_id, score and last_word of the documents and items that share a seed and align."""
    items = [(i, k, w) for i, k, w in ((i, k, word_numbers(t)) for i, k, t in items) if len(w) >= n]
    shared = docs.sparkSession.sparkContext.broadcast((Lookup([w for *_, w in items], n - 1), [x[:2] for x in items]))

    def make():
        lookup, names = shared.value
        first = lookup.filter()

        def work(cols):
            out = {k: [] for k in ("id", "k1", "k2", "item", "item_id", "score", "last_word")}
            for i, k1, k2, text in zip(cols["id"], cols["k1"], cols["k2"], cols["text"], strict=True):
                words = word_numbers(text or "")
                if len(words) < n:
                    continue
                for k, low, high in lookup.shared(words, first):
                    item = lookup.item(k)
                    start = max(0, low - 2 * len(item))
                    part = words[start : high + n + 2 * len(item)]
                    score, end = best_alignment(item, part) if can_leak(item, part, threshold) else (-1.0, 0)
                    if score >= threshold:
                        for name, value in zip(out, (i, k1, k2, *names[k], score, start + end), strict=True):
                            out[name].append(value)
            return out

        return work

    return map_texts(docs, "id bigint, k1 bigint, k2 bigint, item bigint, item_id bigint, score double, last_word int", make)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), *row_key(F.col("doc_id"), F.col("text")), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """id and row key (k1, k2) of a document row, item_id, score and last_word (the place of the alignment's end) of each leak."""
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text")))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks, found = max(1, -(-total // table_grams)), None
    for block in range(blocks):  # each block has items of TABLE_GRAMS words on average, which bounds what is broadcast
        some = [(r.item, r.item_id, r.text) for r in items.filter(F.pmod("item", F.lit(blocks)) == block).select("item", "item_id", "text").collect()]
        if some:
            part = _aligned(_keyed(docs), some, threshold, n)
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "id bigint, k1 bigint, k2 bigint, item_id bigint, score double, last_word int")
    return found.distinct().drop("item")


def leaked_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score and last_word of each leak; documents without leaks have no row."""
    return leaks(docs, benchmark, threshold).select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "item_id", "score", "last_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no item leaked into, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    gone = stored(leaks(docs, benchmark, threshold).select("k1", "k2").distinct())
    plain = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(docs.columns, names, strict=True)], *row_key(F.col("doc_id"), F.col("text")))
    return plain.join(gone, ["k1", "k2"], "left_anti").select(*names).toDF(*docs.columns)

"""Near-duplicate classes from BagMinHash signatures of word-shingle multisets.

Each shingle of a document spawns Poisson processes on (weight, time): one on the weights [0, 1) and one on each [2^j, 2^(j+1)), at a
rate of that width. A point belongs to a shingle of weight w if its weight lies below w; a range that w cuts is halved, and halved
again, by the bits of a hash until each point is on one side. Each point also falls on one of the signature's components, which keep
their earliest time. Two components agree with the probability of the weighted Jaccard similarity. A process stops as
soon as its time is past the latest component, so long texts cost little more than a point a shingle.

Components are banded; documents that share a band are candidates. Candidates of a band are not paired with each other in a table: one of
them leads, and each other is compared with it on its exact shingle counts. Those of one class need no comparison among themselves; a band that
then has several classes is compared class with class inside tasks, in parts of bounded size, again on exact counts. So every link that a band holds is
found, and there is no limit on the size or number of candidates. Tables have a row for each document of a band; only a band of
over 2,000 documents outside its largest class has copies of them, for each two of its parts that meet.

Words are runs of non-spaces; a text of fewer words than a shingle has one shingle of all its words. Equal texts are one node, null
being an empty text, so texts without words are a class of their own kind by kind. Rows with one doc_id and different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WordCache, enter, map_texts, remembers, stored

WORDS, SIMILARITY = 5, 0.8

#: Components of a band and bands: a pair at the similarity 0.8 shares no band with probability 7e-5.
ROWS, BANDS = 5, 24

#: Rows and bytes of text of a key that one task compares with each other.
PART_ROWS, PART_BYTES = 2000, 8 << 20

#: Most leaders of a key before its classes are compared.
LEADERS = 6

_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_NO_ID = -(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLY[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLY[2]
    return x ^ (x >> np.uint64(31))


_hashes = WordCache(lambda w: xxhash.xxh3_64_intdigest(w.encode()))
remembers(__name__, _hashes.clear)


def shingle_bag(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles and how often each occurs."""
    numbers = np.array(list(map(_hashes.__getitem__, text.split())), np.uint64)
    n = min(words, len(numbers))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + numbers[k : len(numbers) - n + 1 + k] + _MULTIPLY[0])
    return np.unique(out, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures, one row a bag; components are times, infinite for an empty bag."""
    element = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if bags else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    ranges = [(np.arange(len(element)), np.zeros(len(element), np.int64), np.ones(len(element), np.int64))]  # element, start of the range, its width
    low = 1
    while len(element) and low < weight.max():
        at = np.flatnonzero(weight > low)
        ranges.append((at, np.full(len(at), low), np.full(len(at), low)))
        low *= 2
    at, start, width = (np.concatenate(x) for x in zip(*ranges, strict=True))
    seed, owner, inside = mixed(element[at] + mixed((start + 1).astype(np.uint64) * _MULTIPLY[0])), owner[at], np.minimum(weight[at] - start, width)
    time, k = np.zeros(len(at)), 0
    out = np.full((len(bags), size), np.inf)
    while len(seed):
        many = int(np.clip(100_000 // len(seed), 1, 32))  # points of each process in one go; how many changes no result
        steps = mixed(seed[:, None] + np.arange(k + 1, k + many + 1, dtype=np.uint64)[None] * _MULTIPLY[0])
        gaps = -np.log(((steps >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        other = mixed(steps + _MULTIPLY[2])
        place = ((mixed(other + _MULTIPLY[0]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width[:, None]).astype(np.int64)
        row, column = np.nonzero(place < inside[:, None])
        np.minimum.at(out.reshape(-1), owner[row] * size + (other[row, column] % np.uint64(size)).astype(np.int64), times[row, column])
        time, k = times[:, -1], k + many
        going = time < out.max(axis=1)[owner]
        seed, owner, inside, width, time = seed[going], owner[going], inside[going], width[going], time[going]
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.view(np.uint64).reshape(len(signature), -1, rows)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        keys = mixed(keys + _MULTIPLY[0] + parts[:, :, r])
    return keys.view(np.int64)


def text_node(text: Column) -> Column:
    """What equal texts share: 128 bits of the whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(_NO_ID))


def band_rows(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key and node of each band of each different text that has words."""

    def make():
        def work(cols):
            bags = [shingle_bag(t or "", words) for t in cols["text"]]
            kept = [i for i, b in enumerate(bags) if len(b[0])]
            keys = band_keys(signatures([bags[i] for i in kept], bands * rows), rows)
            return {"node": [cols["node"][i] for i in kept for _ in range(bands)], "key": keys.reshape(-1)}

        return work

    return map_texts(docs.select("text", text_node(F.col("text")).alias("node")), "node binary, key bigint", make).distinct()


def similarities(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """leader, node and similarity of each pair of nodes (leader, node)."""
    a, b = texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text")), texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        last, bag = None, None
        for batch in batches:
            leaders, nodes, left, right = (batch.column(i) for i in range(4))
            out = []
            for i in range(batch.num_rows):
                if leaders[i].as_py() != last:
                    last, bag = leaders[i].as_py(), shingle_bag(left[i].as_py(), words)
                out.append(weighted_jaccard(bag, shingle_bag(right[i].as_py(), words)))
            yield pa.RecordBatch.from_arrays([leaders, nodes, pa.array(out, pa.float64())], names=["leader", "node", "similarity"])

    both = pairs.join(b, "node").join(a, "leader").select("leader", "node", "leader_text", "text")
    return both.mapInArrow(run, "leader binary, node binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node and class (the smallest node of its component) for the nodes of edges (a, b).

    Edges are moved to smaller neighbours, first those to larger nodes, then those to smaller ones, until all that is left
    are stars; neighbours are never gathered, only their minimum is.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def moved(e: DataFrame, larger: bool) -> DataFrame:
        near = both(e) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if larger:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while True:
        edges = stored(moved(moved(edges, True), False))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("class"))).distinct()


def units(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash for each shingle and each time it occurs: two bags have as many in common as the smaller counts add up to."""
    nth = np.arange(int(bag[1].sum())) - np.repeat(np.cumsum(bag[1]) - bag[1], bag[1])
    return mixed(np.repeat(bag[0], bag[1]) + nth.astype(np.uint64) * _MULTIPLY[0])


def common_units(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many units each of ``a`` (rows) has in common with each of ``b`` (columns)."""
    out, sides = np.zeros((len(a), len(b))), []
    for bags in (a, b):
        unit, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(x) for x in bags])
        order = np.argsort(unit, kind="stable")
        sides.append((owner[order], *np.unique(unit[order], return_index=True, return_counts=True)))
    (i, left, i0, ni), (j, right, j0, nj) = sides
    _, p, q = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    i0, ni, j0, nj = i0[p], ni[p], j0[q], nj[q]
    met = ni * nj
    dense = met * 100 >= out.size  # of many owners: products of matrices; of few: pair by pair
    some = np.flatnonzero(~dense)
    for at in np.split(some, np.flatnonzero(np.diff(np.cumsum(met[some]) // (1 << 22))) + 1):
        column = np.repeat(at, met[at])
        nth = np.arange(len(column)) - np.repeat(np.cumsum(met[at]) - met[at], met[at])
        np.add.at(out.reshape(-1), i[i0[column] + nth // nj[column]] * len(b) + j[j0[column] + nth % nj[column]], 1.0)
    many = np.flatnonzero(dense)
    for at in (many[k : k + 1024] for k in range(0, len(many), 1024)):
        both = []
        for owner, start, n, size in ((i, i0[at], ni[at], len(a)), (j, j0[at], nj[at], len(b))):
            column = np.repeat(np.arange(len(at)), n)
            both.append(np.zeros((size, len(at)), np.float32))
            both[-1][owner[np.repeat(start, n) + np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)], column] = 1.0
        out += both[0] @ both[1].T
    return out


def class_links(part: pd.DataFrame, threshold: float, words: int) -> pd.DataFrame:
    """Classes (a, b) that links between the rows of part i and those of part j of a key join, no more than there are classes; all links inside if i = j."""
    enter(__name__)
    names, own = np.unique(np.array([bytes(c) for c in part["class"]], object), return_inverse=True)
    if part["i"].iloc[0] == part["j"].iloc[0]:  # links within the largest class tell nothing
        left, right = np.flatnonzero(own != np.bincount(own).argmax()), np.arange(len(own))
    else:
        left, right = (np.flatnonzero((part["part"] == part[c]).to_numpy()) for c in "ij")
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []})
    bags = [units(shingle_bag(t, words)) for t in part["text"]]
    total = np.array([len(x) for x in bags])
    common = common_units([bags[k] for k in left], [bags[k] for k in right])
    every = np.maximum(total[left][:, None] + total[right][None] - common, 1.0)
    x, y = np.nonzero((common / every >= threshold) & (own[left][:, None] != own[right][None]))
    x, y, root = own[left[x]], own[right[y]], np.arange(len(names))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y, before[x], before[y]):
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[moved], "b": names[root[moved]]})


def links_in_keys(rows: DataFrame, texts: DataFrame, threshold: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of classes that links between rows (key, node, class) of one key join, by the exact similarity of all rows of a key whose classes differ.

    A key of up to ``PART_ROWS`` rows and ``PART_BYTES`` of text is one task's. A larger one is dealt into parts, and two parts at a time meet: those of the
    largest class meet all others, but not each other.
    """

    def parts(n, size):
        return F.greatest(F.ceil(n / PART_ROWS), F.ceil(size / PART_BYTES), F.lit(1)).cast("int")

    sized = rows.join(texts.select("node", F.octet_length("text").cast("bigint").alias("bytes")), "node")
    by_class = sized.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    by_key = by_class.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "class")).alias("m"))
    small = parts(F.col("n"), F.col("bytes")) == 1
    rest = F.when(small, 1).otherwise(parts(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("m.bytes"))).alias("rest")
    main = F.when(small, 0).otherwise(parts(F.col("m.n"), F.col("m.bytes"))).alias("main")
    dealt = rows.join(by_key.select("key", rest, main, F.col("m.class").alias("largest")), "key")
    hashed = F.xxhash64("node")
    part = F.when(F.col("main") == 0, F.lit(0)).when(F.col("class") == F.col("largest"), F.col("rest") + F.pmod(hashed, "main")).otherwise(F.pmod(hashed, "rest"))
    dealt = dealt.withColumn("part", part.cast("int"))
    last = F.when(F.col("part") < F.col("rest"), F.col("rest") + F.col("main") - 1).otherwise(F.col("rest") - 1)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    met = met.select("key", "node", "class", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return met.join(texts, "node").groupBy("key", "i", "j").applyInPandas(lambda part: class_links(part, threshold, words), "a binary, b binary")


def node_classes(rows: DataFrame, texts: DataFrame, threshold: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """node and class of the nodes linked to others; ``rows`` are the candidate rows (key, node) of keys with several nodes.

    Every two nodes that share a key and are similar enough end in one class. First one node leads each key, that which shares keys with the most
    others, such as the origin of many edited copies; keys with many rows outside its class get further leaders. Then the rows of keys that still have
    several classes are compared, class with class.
    """
    sets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    sets = sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")  # keys of the same nodes are one
    rows = stored(rows.join(sets, "key"))
    weight = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    rows = rows.join(weight, "node").select("key", "node", "weight", F.col("node").alias("class"))
    leading, links, turn = rows, [], 0
    while True:
        turn += 1
        first = F.struct("weight", "node", "class") if turn == 1 else F.struct(F.xxhash64(F.lit(turn), "node").alias("weight"), "node", "class")
        leaders = leading.groupBy("key").agg(F.max(first).alias("l")).select("key", F.col("l.node").alias("leader"), F.col("l.class").alias("leader_class"))
        pairs = rows.join(leaders, "key").filter(F.col("class") != F.col("leader_class")).select("leader", "node").distinct()
        found = similarities(pairs, texts, words).filter(F.col("similarity") >= threshold)
        links.append(stored(found.select(F.col("leader").alias("a"), F.col("node").alias("b"))))
        classes = components(reduce(DataFrame.union, links))
        rows = rows.drop("class").join(classes, "node", "left").select("key", "node", "weight", F.coalesce("class", "node").alias("class"))
        by_class = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
        by_key = by_class.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("m")).filter("n > m.n AND n > 2")  # others are done
        rows = stored(rows.join(by_key.select("key", (F.col("n") - F.col("m.n")).alias("rest"), F.col("m.class").alias("largest")), "key"))
        if rows.isEmpty():
            return classes
        leading = rows.filter((F.col("rest") > PART_ROWS) & (F.col("class") != F.col("largest")))
        if turn == LEADERS or leading.isEmpty():
            break
        rows = rows.drop("rest", "largest")
    links.append(stored(links_in_keys(rows.select("key", "node", "class"), texts, threshold, words)))
    return components(reduce(DataFrame.union, links))


def duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node, id (doc_id, the least number for null) and copies of each different row, with the class of its text: the least id in it, and that id's node."""
    copies = docs.select(text_node(F.col("text")).alias("node"), _id(F.col("doc_id")).alias("id")).groupBy("node", "id").agg(F.count("*").alias("copies"))
    candidates = stored(band_rows(docs, words, bands, rows))
    shared = candidates.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    candidates = stored(candidates.join(shared, "key"))
    copies = stored(copies)
    first = copies.join(candidates.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id"))
    rows_of = docs.select(text_node(F.col("text")).alias("node"), _id(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = stored(rows_of.join(first, ["node", "id"]).dropDuplicates(["node"]).select("node", "text"))
    classes = node_classes(candidates, texts, threshold, words)
    joined = copies.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = joined.groupBy("class").agg(F.min(F.struct("id", "node")).alias("least"), F.sum("copies").alias("class_size"))
    return joined.join(least, "class").select("node", "id", "copies", "class_size", F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node"))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: doc_id, class_id (the least doc_id of its class; null ids come first), class_size and kept, which is true for one row of each class.

    Of equal rows the first gets kept.
    """
    found = duplicate_classes(docs, threshold, words, bands, rows)
    each = found.select("*", F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth", "_"))
    kept = (F.col("id") == F.col("class_id")) & (F.col("node") == F.col("class_node")) & (F.col("nth") == 0)
    plain = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias("doc_id" if c == "id" else c)
    return each.select(plain("id"), plain("class_id"), "class_size", kept.alias("kept"))


def without_duplicates(docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each class: a row with the least doc_id."""
    found = duplicate_classes(docs, threshold, words, bands, rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # columns may have any names
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    best = found.filter((F.col("id") == F.col("class_id")) & (F.col("node") == F.col("class_node"))).select("node", "id", "copies")
    kept = plain.withColumns({"node": text_node(F.col(at["text"])), "id": _id(F.col(at["doc_id"]))}).join(stored(best), ["node", "id"])
    once = kept.filter("copies = 1").select(*names)
    several = kept.filter("copies > 1").dropDuplicates(["node", "id"]).select(*names)
    return once.union(several).toDF(*docs.columns)

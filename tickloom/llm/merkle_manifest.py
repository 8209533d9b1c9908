"""Merkle manifest of a table: a tree of sha256 digests over each language's rows, and a proof for every row.

Rows are leaves, in each language by ascending doc_id (no id first, then by digest). Every 8 neighbouring nodes become their
digest, the last run as many as there are, until one node is left in a language, its subroot; subroots, by language (none first),
make the root in the same way.

Digests move by time-forward processing. A node's label is the last leaf below it and its level, so children come before
their parent, and a node's digest is a message to the parent, which waits in a priority queue ordered by the label of its reader; at no
time does the queue of a task hold more than one run a level. A reversed sweep over the labels hands every node the siblings
on its way to the root: a child gets its own siblings and then what its parent got. The external part of the queue is Spark's
exchange: blocks of 8^4 neighbouring nodes go through a task's queue, and their top nodes are the messages of the next round, sorted by label. So a
language with most of the rows is dealt over many tasks, and a sweep takes one round for each factor 4096 of rows.

Null values have a digest of their own, repeated rows are leaves of their own, an empty table gives no rows, extra columns take no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.llm.common import enter, stored

#: Children of a node, as a power of two, and levels of a block.
FAN_BITS, HEIGHT = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64

PATH = "array<struct<slot int, others string>>"
Path = list[dict[str, int | str]]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- one block -------------------------------------------------------------------------------------
def height_of(size: int) -> int:
    """Levels above ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size >> FAN_BITS), levels + 1
    return levels


def forward(digests: Sequence[str], height: int) -> tuple[str, dict[tuple[int, int], list[tuple[int, str]]]]:
    """The node ``height`` levels above all leaves, and the children (last leaf, digest) of each node by its label (last leaf, level)."""
    if height == 0:
        return digests[0], {}
    end, queue, children, done = len(digests) - 1, [], {}, ""
    for leaf, digest in enumerate(digests):
        heapq.heappush(queue, (min(leaf | ((1 << FAN_BITS) - 1), end), 1, leaf, digest))
        while queue and queue[0][0] <= leaf:
            last, level = label = queue[0][:2]
            run = []
            while queue and queue[0][:2] == label:
                run.append(heapq.heappop(queue)[2:])
            children[label] = run
            done = sha("".join(d for _, d in run))
            if level < height:
                heapq.heappush(queue, (min(last | ((1 << FAN_BITS * (level + 1)) - 1), end), level + 1, last, done))
    return done, children


def backward(children: dict[tuple[int, int], list[tuple[int, str]]], leaves: int, height: int, above: Path) -> list[Path]:
    """The path of each leaf: at every level its slot and its siblings' digests, then what is above the block."""
    out: list[Path] = [above] * leaves
    queue = [(-(leaves - 1), -height, above)] if height else []
    while queue:
        last, level, path = heapq.heappop(queue)
        run = children[-last, -level]
        whole = "".join(d for _, d in run)
        for slot, (at, _) in enumerate(run):
            own = [{"slot": slot, "others": whole[: HEX * slot] + whole[HEX * (slot + 1) :]}, *path]
            if level == -1:
                out[at] = own
            else:
                heapq.heappush(queue, (-at, level + 1, own))
    return out


def fold(digest: str, path: Path) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        cut = HEX * step["slot"]
        digest = sha(step["others"][:cut] + digest + step["others"][cut:])
    return digest


# --- the table -------------------------------------------------------------------------------------
def _field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and, where tampering changes a row, changed: the digest of the row with its letters A-Z in lower case."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", letters, letters.lower())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = F.sha2(F.concat(*[_field(n) for n in FIELDS]), 256)
    other = F.sha2(F.concat(*[_field(n) for n in FIELDS[:-1]], _field("text", lowered)), 256)
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered & (lowered != F.col("text")), other).alias("changed"))


def number(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add pos, the place of a row among those equal in ``by`` (nulls are equal), and size, their count.

    Rows are sorted by ranges, numbered inside a range, and each range adds the rows of the ranges before it.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    arrow, at = to_arrow_schema(schema), [rows.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for key in zip(*[batch.column(i).to_pylist() for i in at]) if at else [()] * batch.num_rows:
                last, count = (key, count + 1) if key == last else (key, 1)
                local.append(count - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), "int32"), pa.array(local, "int64")], schema=arrow)

    keys = [*by, *order]
    local = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    counts = local.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], before.alias("_before"), F.sum("_n").over(w).alias("size"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return local.join(base, same).select(*rows.columns, (F.col("_before") + F.col("_local")).alias("pos"), "size")


def _block(name: str = "pos") -> Column:
    return F.shiftright(name, FAN_BITS * HEIGHT).alias("block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of (tree, pos, size, digest): the given nodes, the tops of their blocks and so on, until each tree has one."""

    def run(key, table):
        enter(__name__)
        tree, block, size = (k.as_py() for k in key)
        digests = table.sort_by("pos").column("digest").to_pylist()
        top, _ = forward(digests, min(height_of(size), HEIGHT))
        return pa.table({"tree": [tree], "pos": [block], "size": [-(-size >> FAN_BITS * HEIGHT)], "digest": [top]})

    rounds = [nodes]
    left = nodes.agg(F.max("size")).first()[0] or 0
    while left > 1:
        up = rounds[-1].groupBy("tree", _block(), "size").applyInArrow(run, "tree bigint, pos bigint, size bigint, digest string")
        rounds.append(stored(up))
        left = -(-left >> FAN_BITS * HEIGHT)
    return rounds


def descend(nodes: DataFrame, above: DataFrame, keep: Sequence[str], out: str, finish) -> DataFrame:
    """Hand the paths of the tops of blocks (tree, pos, path, further columns) down to the nodes of each block.

    ``finish(rows, paths, top)`` turns a block's rows, their paths and the top's row into output columns.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(out))

    def run(left, right):
        enter(__name__)
        if not left.num_rows:
            return arrow.empty_table()
        rows, top = left.sort_by("pos").to_pydict(), right.to_pylist()[0]
        height = min(height_of(rows["size"][0]), HEIGHT)
        _, children = forward(rows["digest"], height)
        got = finish(rows, backward(children, len(rows["pos"]), height, top["path"]), top)
        return pa.table([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    left = nodes.select("tree", "pos", "size", "digest", *keep, _block())
    return left.groupBy("tree", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(run, out)


def paths(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the second round's nodes, given those of the last round's only nodes."""
    extra = [f for f in above.schema.fields if f.name not in ("tree", "pos", "path")]
    out = f"tree bigint, pos bigint, path {PATH}" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)

    def finish(rows, found, top):
        n = len(found)
        return {"tree": rows["tree"], "pos": rows["pos"], "path": found, **{f.name: [top[f.name]] * n for f in extra}}

    for nodes in reversed(rounds[1:-1]):
        above = stored(descend(nodes, above, [], out, finish))
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path, changed of each row; the path holds slot and siblings of every level from the leaf to the root."""

    def finish(rows, found, top):
        n = len(found)
        return {**{c: rows[c] for c in ("doc_id", "leaf", "changed")}, "subroot": [top["subroot"]] * n, "root": [top["root"]] * n, "path": found}

    return _sweep(docs, f"doc_id bigint, leaf string, changed string, subroot string, root string, path {PATH}", finish)


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings from leaf to root), folded_root (from the tampered leaf and these siblings) and verified."""

    def finish(rows, found, top):
        n = len(found)
        folded = [fold(c or d, p) for c, d, p in zip(rows["changed"], rows["leaf"], found, strict=True)]
        return {
            "doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": [top["subroot"]] * n, "root": [top["root"]] * n,
            "proof_sha256": [sha("".join(s["others"] for s in p)) for p in found], "folded_root": folded, "verified": [f == top["root"] for f in folded],
        }

    return _sweep(docs, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", finish)


def _sweep(docs: DataFrame, out: str, finish) -> DataFrame:
    rows = stored(number(stored(leaf_digests(docs)), ["lang"], ["doc_id", "leaf"]))
    trees = stored(number(rows.filter("pos = 0").select("lang"), [], ["lang"]).select("lang", F.col("pos").alias("tree"), F.col("size").alias("trees")))
    named = trees.select(F.col("lang").alias("_lang"), "tree")
    nodes = stored(rows.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "pos", "size", F.col("leaf").alias("digest"), "doc_id", "leaf", "changed"))
    rounds = climb(nodes)
    roots = climb(rounds[-1].join(trees, "tree").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("size"), "digest"))
    start = roots[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = paths(roots, start)
    if len(roots) > 1:

        def hand(rows, found, top):
            return {"tree": rows["pos"], "pos": [0] * len(found), "path": found, "root": [top["root"]] * len(found), "subroot": rows["digest"]}

        above = stored(descend(roots[0], above, [], f"tree bigint, pos bigint, path {PATH}, root string, subroot string", hand))
    else:
        above = above.withColumn("subroot", F.col("root"))
    above = paths(rounds, above)
    return descend(nodes, above, ["doc_id", "leaf", "changed"], out, finish)

"""Exact nearest neighbours by pivots: blocks that cannot hold a neighbour are not visited.

Training rows go to the nearest of a bounded number of pivots and, inside such a cell, to shells by their distance from
the pivot, so a shell is known by its cell, its least and its largest distance. Shells that stay too large (many equal rows) are dealt
into parts; small ones are packed with those of the cells around them. These are the blocks: about as many as the rows fill. A query's first bound
comes from counts and radii alone: cells that hold ``k`` rows in all within it. The first round visits one block, that of the nearest shell
of the query's own cell, and tightens the bound to the k-th distance found there; the second visits the blocks that the triangle
inequality leaves. Queries of one first block share their tasks, so a block is copied to the crowds that visit it, not to all queries.

Where the inequality leaves most blocks (many dimensions without clusters) the work is that of all pairs: one single-precision product a
pair tells which rows may be within the bound, and only those get an exact distance. No table has a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

#: Most pivots; each costs a distance a row and its coordinates on every executor.
PIVOTS = 1024

#: Distances that a task holds at once, and pairs whose exact distances it takes at once.
TOGETHER, EXACT = 1 << 20, 1 << 15


def point_of(df: DataFrame, cols: Sequence[str]) -> Column:
    """The coordinates as one array; NULL where one is missing or not finite."""
    if len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array":
        at = F.col(cols[0])
        if df.schema[cols[0]].dataType.elementType.typeName() != "float":
            at = at.cast("array<double>")
        return F.when(~F.exists(at, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), at)
    parts = [F.col(c).cast("double") for c in cols]
    total = sum((F.abs(p) for p in parts[1:]), F.abs(parts[0]))
    return F.when(total < float("inf"), F.array(*parts))


def distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all rows of ``a`` from all rows of ``b``, and for each row of ``a`` how far they may be off."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    off = np.sqrt(1e-12 * (aa + bb.max(initial=0.0))) + 1e-12
    return np.sqrt(np.maximum(aa[:, None] + bb[None, :] - 2.0 * (a @ b.T), 0.0)), off


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` from those of ``b``, pair by pair; equal rows give equal distances wherever they stand."""
    parts = [np.sqrt(((a[i : i + EXACT] - b[i : i + EXACT]) ** 2).sum(1)) for i in range(0, len(a), EXACT)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _first_copies(b: np.ndarray, k: int) -> np.ndarray:
    """Places of rows that have fewer than ``k`` equal rows before them."""
    _, group, count = np.unique(np.ascontiguousarray(b + 0.0).view(f"V{8 * b.shape[1]}")[:, 0], return_inverse=True, return_counts=True)
    if count.max() <= k:
        return np.arange(len(b))
    order = np.argsort(group, kind="stable")
    nth = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(order[nth < k])


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of a block for each query, none beyond its bound. Distances are exact; ids decide ties."""
    right = right.sort_values("_id")
    a, b = _stack(left["_x"]), _stack(right["_x"])
    use = _first_copies(b, k)
    b, ids, labels = b[use], right["_id"].to_numpy(dtype=object)[use], right["_label"].to_numpy()[use]
    own, bounds, take, out = left["_id"].to_numpy(dtype=object), left["_bound"].to_numpy(float), min(k, len(b)), []
    middle = b.mean(0)
    near_b = b - middle
    scale = max(np.abs(near_b).max(), np.abs(a - middle).max()) or 1.0
    near_b /= scale
    off = 8 * (b.shape[1] + 8) * float(np.finfo(np.float32).eps)  # a product may be off by this share of both squares
    wide = np.concatenate([near_b, (1 - off) * (near_b * near_b).sum(1)[:, None]], axis=1).astype(np.float32).T.copy()
    step = max(1, TOGETHER // len(b))
    for s in range(0, len(a), step):
        x, bound = a[s : s + step], bounds[s : s + step]
        c = (x - middle) / scale
        square = (1 - off) * (c * c).sum(1)
        about = np.concatenate([-2 * c, np.ones((len(c), 1))], axis=1).astype(np.float32) @ wide  # squares less those of the query, never too large

        def hits(bound: np.ndarray) -> np.ndarray:
            most = (bound / scale) ** 2 * (1 + 1e-6) - square
            return np.flatnonzero(about <= (most + 1e-6 * np.abs(most) + 1e-35).astype(np.float32)[:, None])

        found = hits(bound)
        if len(found) > 8 * k * len(x) and take < len(b):  # the bound is wide: take that of the k rows that seem nearest
            seem = np.argpartition(about, take - 1, axis=1)[:, :take].ravel()
            bound = np.minimum(bound, _exact(np.repeat(x, take, axis=0), b[seem]).reshape(-1, take).max(1))
            found = hits(bound)
        row, at = np.divmod(found, len(b))
        dist = np.concatenate([np.zeros(0), *(_exact(x[row[i : i + EXACT]], b[at[i : i + EXACT]]) for i in range(0, len(row), EXACT))])
        kept = dist <= bound[row]
        row, at, dist = row[kept], at[kept], dist[kept]
        order = np.lexsort((at, dist, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
        out.append((row[order] + s, dist[order], at[order]))
    row, dist, at = (np.concatenate(v) for v in zip(*out, strict=True))
    return pd.DataFrame({"_id": pd.Series(own[row], dtype=object), "dist": dist, "near": pd.Series(ids[at], dtype=object), "_label": labels[at]})


def _chain(centres: np.ndarray) -> np.ndarray:
    """An order of the pivots in which each is followed by the nearest one left."""
    d, _ = distances(centres, centres)
    out, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        out.append(int(np.where(left, d[out[-1]], np.inf).argmin()))
        left[out[-1]] = False
    return np.array(out)


def _packed(shells: pd.DataFrame, centres: np.ndarray, block_rows: int) -> pd.DataFrame:
    """Shells in the order of the chain with their first block and its number of parts; small shells share a block."""
    place = np.argsort(_chain(centres))
    shells = shells.assign(_place=place[shells["_cell"]]).sort_values(["_place", "_shell"], ignore_index=True)
    first, parts, block, held = [], [], -1, block_rows
    for n in shells["_n"].tolist():
        parts.append(max(1, -(-n // block_rows)))
        if n > block_rows or held + n > block_rows:
            block, held = block + 1, 0
        first.append(block)
        held += n
        if n > block_rows:
            block, held = block + parts[-1] - 1, block_rows
    return shells.assign(_block=first, _parts=parts)


def nearest(train: DataFrame, query: DataFrame, cols: Sequence[str], label: str, key: str, k: int = 5, block_rows: int = 20_000, pivots: int = PIVOTS) -> DataFrame:
    """(key, neighbours, visited, blocks): the ``k`` nearest training rows of each query row, exactly, and of how many blocks it met how many.

    A vector column may be given as the only column. Rows with a missing coordinate have and are no neighbours, and a training row
    without a label is none. A task compares about ``block_rows`` rows of either side at most.
    """
    kind = train.schema[key].dataType.simpleString()
    t = train.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_label"), point_of(train, cols).alias("_x")).filter("_label IS NOT NULL AND _x IS NOT NULL")
    q = query.select(F.col(key).alias("_id"), point_of(query, cols).alias("_x")).filter("_x IS NOT NULL")
    point, asked = t.schema["_x"].dataType.simpleString(), q.schema["_x"].dataType.simpleString()
    count = t.count()
    chosen = t.orderBy(F.xxhash64("_id"), "_id").limit(max(1, min(pivots, int(np.ceil(np.sqrt(count)))))).select("_x").collect()
    if not chosen:
        return query.sparkSession.createDataFrame([], f"{key} {kind}, neighbours array<struct<dist: double, near: {kind}, label: double>>, visited bigint, blocks bigint")
    centres = np.unique(np.array([r["_x"] for r in chosen], float), axis=0)
    middle = centres.mean(0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d, _ = distances(_stack(pdf["_x"]) - middle, centres - middle) if len(pdf) else (np.zeros((0, 1)), None)
            yield pdf.assign(_cell=d.argmin(1).astype("int32"), _d=d.min(1))

    t = cut_lineage(t.mapInPandas(assign, f"_id {kind}, _label double, _x {point}, _cell int, _d double"))
    cells = t.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_radius"))
    known = cells.collect()  # one row a pivot
    sizes, radii = np.zeros(len(centres)), np.zeros(len(centres))
    for r in known:
        sizes[r["_cell"]], radii[r["_cell"]] = r["_n"], r["_radius"]

    shells = F.ceil(F.col("_n") / block_rows)
    shell = F.least(F.floor(F.col("_d") * shells / F.col("_radius")), shells - 1)
    t = t.join(F.broadcast(cells), "_cell").withColumn("_shell", F.when(F.col("_radius") > 0, shell).otherwise(F.lit(0)).cast("bigint")).drop("_n", "_radius")
    dealt = t.groupBy("_cell", "_shell").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    dealt = _packed(dealt.toPandas(), centres, block_rows)  # a row a pivot, and no more than one for each block_rows rows besides
    of_cell, low, high, of_shell = dealt["_cell"].to_numpy(), dealt["_low"].to_numpy(), dealt["_high"].to_numpy(), dealt["_block"].to_numpy()
    starts = np.flatnonzero(np.diff(of_shell, prepend=-1))  # shells of one block stand together
    of_block = np.repeat(np.arange(len(starts)), dealt["_parts"].to_numpy()[starts])
    at = query.sparkSession.createDataFrame(dealt[["_cell", "_shell", "_block", "_parts"]].astype({"_cell": "int32"}))
    t = t.join(F.broadcast(at), ["_cell", "_shell"]).select("_id", "_x", "_label", (F.col("_block") + F.pmod(F.xxhash64("_id"), "_parts")).alias("_block"))

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, TOGETHER // max(len(centres), len(of_cell), len(of_block)))
        for pdf in (b.iloc[i : i + step] for b in batches for i in range(0, len(b), step)):
            d, off = distances(_stack(pdf["_x"]) - middle, centres - middle)
            far = np.where(sizes > 0, d + radii, np.inf)
            order = np.argsort(far, axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())).argmax(1)
            bound = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0] + 4 * off
            home = np.where(sizes > 0, d, np.inf).argmin(1)
            d = d[:, of_cell]
            least = np.maximum(np.maximum(d - high, low - d), 0.0) - 4 * off[:, None]
            first = of_shell[np.where(of_cell == home[:, None], least, np.inf).argmin(1)]
            least = np.minimum.reduceat(least, starts, axis=1)[:, of_block]
            reach = least <= bound[:, None]
            reach[np.arange(len(reach)), first] = False
            yield pdf.assign(_home=first, _bound=bound, _open=[np.flatnonzero(r) for r in reach], _least=[v[r] for v, r in zip(least, reach, strict=True)])

    q = cut_lineage(q.mapInPandas(aim, f"_id {kind}, _x {asked}, _home bigint, _bound double, _open array<bigint>, _least array<double>"))
    crowds = q.groupBy("_home").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_crowds"))
    q = q.join(F.broadcast(crowds), "_home").withColumn("_crowd", F.pmod(F.xxhash64("_id"), "_crowds")).drop("_crowds")
    group = ["_block", "_home", "_crowd"]

    def meet(visits: DataFrame) -> DataFrame:
        """Candidates of visits (query columns and a block), each block copied to the crowds of queries that visit it."""
        copies = visits.select(*[F.col(c).alias(f"_r{c}") for c in group]).distinct().toDF(*group)
        left = visits.select(*group, "_id", "_x", "_bound").groupBy(*group)
        right = t.join(copies, "_block").select(*group, "_id", "_x", "_label").groupBy(*group)

        def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"_id": [], "dist": [], "near": [], "_label": []})
            return _best(a, b, k)

        return left.cogroup(right).applyInPandas(match, f"_id {kind}, dist double, near {kind}, _label double")

    found = cut_lineage(meet(q.withColumn("_block", F.col("_home"))))
    tight = found.groupBy("_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_k"))
    others = q.join(tight, "_id", "left").withColumn("_bound", F.least("_bound", F.col("_k"))).drop("_k")
    others = cut_lineage(others.withColumn("_open", F.filter("_open", lambda b, i: F.get("_least", i) <= F.col("_bound"))).drop("_least"))
    every = found.unionByName(meet(others.select("*", F.explode("_open").alias("_block"))))
    # Each task keeps k rows a query before the exchange, so no list grows with the blocks.
    best = every.withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("dist", "near"))).filter(F.col("_r") <= k)
    lists = best.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("dist", "near", F.col("_label").alias("label")))).alias("neighbours"))
    visits = others.groupBy("_id").agg(F.sum(F.size("_open")).alias("_v"))
    return lists.join(visits, "_id").select(F.col("_id").alias(key), "neighbours", (F.col("_v") + 1).alias("visited"), F.lit(len(of_block)).cast("bigint").alias("blocks"))

"""Feature scores, rankings and set operations on selections.

Scores are one-pass aggregates over the rows. What follows works on score and correlation tables,
whose size is set by the number of features and methods, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ranks import long_form, quantiles, value_counts
from tickloom.operators.series import running
from tickloom.session import cut_lineage


def _pearson(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _pair_sums(rows: DataFrame, p: int) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i before j, from an array column ``v`` of p centred values with NULL for missing.

    Each task adds up the products of its rows as p x p matrices; the sums of tasks add up by pair.
    """
    names = ("i", "j", "n", "sx", "sy", "sxx", "syy", "sxy")
    i, j = np.triu_indices(p, 1)

    def run(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            values = batch.column(0)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            have = ~np.isnan(flat)
            x, m = np.where(have, flat, 0.0), have.astype(float)
            total += m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        n, s, q, c = total
        columns = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], c[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k < 2 else pa.float64()) for k, v in enumerate(columns)], names=list(names))

    parts = rows.mapInArrow(run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _correlated(rows: DataFrame, cols: Sequence[str], size: Sequence[float]) -> DataFrame:
    """(a, b, r) from arrays of centred values. A spread that is rounding noise of a column of that ``size`` counts as none."""
    sums, name = _pair_sums(rows, len(cols)), F.array(*[F.lit(c) for c in cols])
    square = F.array(*[F.lit(float(s) ** 2) for s in size])

    def spread(q: str, s: str, k: str) -> Column:
        v = F.col(q) - F.col(s) * F.try_divide(F.col(s), F.col("n"))
        return F.when(v > 1e-24 * (F.col(q) + F.col("n") * square[F.col(k)]), v)

    together = F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), F.col("n"))
    r = together / (F.sqrt(spread("sxx", "sx", "i")) * F.sqrt(spread("syy", "sy", "j")))
    return sums.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.when(F.col("n") > 1, r).alias("r"))


def correlations(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for every pair a before b. Pearson skips rows where either side is missing (NULL or NaN)."""
    cols = list(cols)
    if method == "pearson":
        if len(cols) < 2:
            return df.sparkSession.createDataFrame([], "a string, b string, r double")
        value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
        centre = [m or 0.0 for m in df.agg(*[F.avg(value[c]) for c in cols]).first()]
        return _correlated(df.select(F.array(*[value[c] - m for c, m in zip(cols, centre, strict=True)]).alias("v")), cols, centre)
    if method == "spearman":
        return rank_correlations(df, cols)
    if method == "kendall":
        return kendall_matrix(df, cols)
    raise ValueError(f"unknown method {method!r}")


def rank_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spearman: Pearson of average ranks. Ranks are looked up by value after equal values combined."""
    cols = list(cols)
    rows = cut_lineage(df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols]).withColumn("_id", F.monotonically_increasing_id()))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    counts = value_counts(long_form(rows, cols), ["feature"], "value")
    ranks = counts.select("feature", "value", (F.col("_cum") - (F.col("_cnt") - 1) / 2.0 - (F.col("_n") + 1) / 2.0).alias("_rank"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("feature"), F.col(c).alias("value")) for k, c in enumerate(cols)])).alias("e")
    ranked = rows.select("_id", places).select("_id", "e.*").join(ranks, ["feature", "value"])
    # The mean of average ranks is (n + 1) / 2 whatever the ties, so they come centred.
    wide = ranked.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("k", "_rank"))).alias("e"))
    return _correlated(wide.select(F.transform("e", lambda x: x["_rank"]).alias("v")), cols, [0.0] * len(cols))


def kendall_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r): exact tau-b of every pair a before b over the rows that have both, without comparing rows pairwise.

    Two rows with different ranks of ``a`` first differ at exactly one bit, reading from the top. So discordant
    pairs are counted per (bit, higher bits): among rows ordered by ``b``, how many with a 0 bit lie above each
    row with a 1 bit. Every row appears once per bit in use, and the counts are running sums over
    pre-aggregated values. All columns share one rank table and all pairs each step, so the jobs do not grow with the pairs.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    equal = df.select(*[value[c].alias(c) for c in cols]).groupBy(*cols).agg(F.count(F.lit(1)).alias("_rows"))
    rows = cut_lineage(equal.withColumn("_id", F.monotonically_increasing_id()))
    ranks = value_counts(long_form(rows, cols).filter("value IS NOT NULL"), ["feature"], "value").select("feature", "value", F.col("_dense").alias("rank"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("feature"), F.col(c).alias("value")) for k, c in enumerate(cols)])).alias("e")
    placed = rows.select("_id", F.col("_rows").alias("c"), places).select("_id", "c", "e.*").join(ranks, ["feature", "value"])
    wide = placed.groupBy("_id", "c").agg(F.map_from_entries(F.collect_list(F.struct("k", "rank"))).alias("m"))
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.col("m")[i].alias("rx"), F.col("m")[j].alias("ry")) for p, (i, j) in enumerate(pairs)])).alias("e")
    cells = wide.select("c", both).select("e.*", "c").filter("rx IS NOT NULL AND ry IS NOT NULL").groupBy("pair", "rx", "ry").agg(F.sum("c").alias("c"))
    cells = cut_lineage(cells)

    def tied(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("pair").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias(name))

    top = cells.agg(F.coalesce(F.max("rx"), F.lit(0))).first()[0]
    bits = max(1, int(top).bit_length())
    spread = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    halves = spread.select("pair", "bit", F.expr("shiftright(rx, bit + 1)").alias("prefix"), F.expr("shiftright(rx, bit) & 1").alias("side"), "ry", "c")
    zero, one = (F.sum(F.when(F.col("side") == k, F.col("c")).otherwise(0)) for k in (0, 1))
    planes = halves.groupBy("pair", "bit", "prefix", "ry").agg(zero.alias("c0"), one.alias("c1"))
    above = running(planes, {"_above": ("sum", F.col("c0"))}, ["pair", "bit", "prefix"], "ry", bucket=F.expr("ry div 16384"), exclusive=True, descending=True)
    discordant = above.groupBy("pair").agg(F.sum(F.col("c1").cast("double") * F.coalesce("_above", F.lit(0))).alias("d"))
    size = cells.groupBy("pair").agg(F.sum("c").cast("double").alias("n"))
    tx, ty = (cells.groupBy("pair", r).agg(F.sum("c").alias("c")) for r in ("rx", "ry"))
    out = df.sparkSession.createDataFrame([(p, cols[i], cols[j]) for p, (i, j) in enumerate(pairs)], "pair int, a string, b string")
    for part in (size, tied(tx, "tx"), tied(ty, "ty"), tied(cells, "txy"), discordant):
        out = out.join(part, "pair", "left")  # one row a pair
    out = out.withColumn("n0", F.col("n") * (F.col("n") - 1) / 2)
    concordant = F.col("n0") - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    return out.select("a", "b", F.try_divide(concordant - F.col("d"), F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))).alias("r"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact tau-b of one pair."""
    return kendall_matrix(df, [a, b])


def strong_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    return corr.filter(F.abs("r") > threshold).orderBy(F.abs("r").desc(), "a", "b")


def correlated_groups(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(feature, group): features linked by correlations above the threshold share a group label.

    The smallest label spreads along links, and each label is replaced by its own label, until nothing changes;
    the second step halves the length of chains. The table has one row per feature, so a round is a few small joins.
    """
    links = corr.filter(F.abs("r") > threshold).select("a", "b")
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("feature")).distinct().withColumn("group", F.col("feature"))
    while True:
        near = both.join(labels.select(F.col("feature").alias("b"), F.col("group").alias("_g")), "b").groupBy(F.col("a").alias("feature")).agg(F.min("_g").alias("_g"))
        step = cut_lineage(labels.join(near, "feature").select("feature", F.least("group", "_g").alias("group"), (F.col("_g") < F.col("group")).alias("_moved")))
        if step.filter("_moved").isEmpty():
            return step.drop("_moved")
        above = step.select(F.col("feature").alias("group"), F.col("group").alias("_g"))
        labels = cut_lineage(step.join(above, "group").select("feature", F.col("_g").alias("group")))


def greedy_uncorrelated(scores: DataFrame, corr: DataFrame, limit: int | None = None, threshold: float = 0.7) -> list[str]:
    """Best features first, skipping any correlated with one already taken.

    Both inputs have at most features**2 rows.
    """
    near: dict[str, set[str]] = {}
    for r in corr.filter(F.abs("r") > threshold).select("a", "b").collect():
        near.setdefault(r["a"], set()).add(r["b"])
        near.setdefault(r["b"], set()).add(r["a"])
    taken: list[str] = []
    for r in scores.orderBy(F.col("score").desc_nulls_last(), "feature").select("feature").collect():
        if len(taken) == limit:
            break
        if not near.get(r["feature"], set()) & set(taken):
            taken.append(r["feature"])
    return taken


def f_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Univariate linear F statistic of each feature, from one pass of moments."""
    wide = df.agg(
        *[_pearson(c, label).alias(f"r{i}") for i, c in enumerate(cols)],
        *[F.count_if(F.col(c).isNotNull() & F.col(label).isNotNull()).alias(f"n{i}") for i, c in enumerate(cols)],
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cols)]
    out = wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    r2 = F.col("r") * F.col("r")
    return out.select("feature", F.lit("f_regression").alias("method"), F.try_divide(r2, 1 - r2).alias("_q"), "n").select("feature", "method", (F.col("_q") * (F.col("n") - 2)).alias("score"))


def target_correlations(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    wide = df.agg(*[_pearson(c, label).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner quantile edges per column: columns x (bins - 1) numbers."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    table = quantiles(long_form(df, cols), ["feature"], "value", probs)
    return {r["feature"]: [r[p] for p in probs] for r in table.collect()}


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of quantile-binned feature and label, in nats.

    A histogram estimate: it ranks dependence like a nearest-neighbour estimate but its values
    differ from one.
    """
    rows = df.filter(F.col(label).isNotNull())
    edges = bin_edges(rows, [*cols, label], bins)

    def place(c: str) -> Column:
        return sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges[c]), F.lit(0))

    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), place(c)).alias("bx")) for c in cols])
    cells = rows.select(place(label).alias("by"), F.explode(entries).alias("e")).select("e.feature", "e.bx", "by").filter(F.col("bx").isNotNull())
    joint = cells.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # From here on there are at most bins**2 rows per feature.
    per = lambda *k: Window.partitionBy("feature", *k)
    totals = joint.withColumns({"t": F.sum("n").over(per()), "nx": F.sum("n").over(per("bx")), "ny": F.sum("n").over(per("by"))})
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return totals.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score")).select("feature", F.lit("mutual_info").alias("method"), "score")


def ranked(scores: DataFrame) -> DataFrame:
    """Rank features within each method; ties go by name."""
    w = Window.partitionBy("method").orderBy(F.col("score").desc_nulls_last(), "feature")
    return scores.withColumn("rank", F.row_number().over(w))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return ranked(scores).filter(F.col("rank") <= k)


def above_threshold(scores: DataFrame, threshold: float, at_least: int = 1, at_most: int | None = None) -> DataFrame:
    """Features scoring at least ``threshold``, but never fewer than ``at_least`` per method."""
    out = ranked(scores).filter((F.col("score") >= threshold) | (F.col("rank") <= at_least))
    return out.filter(F.col("rank") <= at_most) if at_most else out


def cumulative_share(scores: DataFrame, keep: float | None = None) -> DataFrame:
    """Share of each feature in its method's total and the running share, best first."""
    w = Window.partitionBy("method")
    order = w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranked(scores).withColumn("share", F.try_divide(F.col("score"), F.sum("score").over(w)))
    out = out.withColumn("cumulative", F.sum("share").over(order))
    return out.filter((F.col("cumulative") - F.col("share")) < keep) if keep is not None else out


def overlap(selected: DataFrame) -> DataFrame:
    """Shared features and Jaccard index of every two methods; the lists are as long as the schema."""
    sets = selected.groupBy("method").agg(F.sort_array(F.collect_set("feature")).alias("features"))
    packed = sets.agg(F.sort_array(F.collect_list(F.struct("method", "features"))).alias("m"))
    pairs = packed.select(
        F.explode(
            F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.method AS a, y.method AS b, x.features AS fa, y.features AS fb))))")
        ).alias("p")
    ).select("p.*")
    common, union = F.size(F.array_intersect("fa", "fb")), F.size(F.array_union("fa", "fb"))
    return pairs.select("a", "b", common.cast("long").alias("common"), F.try_divide(common.cast("double"), union.cast("double")).alias("jaccard"))


def consensus(selected: DataFrame, at_least: int = 2) -> DataFrame:
    """Features chosen by several methods with their mean score."""
    return (
        selected.groupBy("feature").agg(F.count_distinct("method").alias("methods"), F.avg("score").alias("score")).filter(F.col("methods") >= at_least)
    )


def mean_importance(importances: DataFrame) -> DataFrame:
    return importances.groupBy("feature").agg(F.avg("score").alias("score"))


def blend_importance(importances: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of each model's importances times its weight, normalised to 1."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("method")]
    summed = importances.groupBy("feature").agg(F.sum(F.col("score") * weight).alias("score"))
    return summed.withColumn("score", F.try_divide(F.col("score"), F.sum("score").over(Window.partitionBy())))


def select_features(df: DataFrame, cols: Sequence[str], label: str, method: str = "f_regression", k: int = 10, threshold: float | None = None) -> list[str]:
    """Names of the ``k`` best features, or of all that reach ``threshold``."""
    score = {"f_regression": f_scores, "mutual_info": mutual_information}
    if method not in score:
        raise ValueError(f"unknown method {method!r}; expected one of {sorted(score)}")
    scores = score[method](df, cols, label)
    chosen = scores.filter(F.col("score") >= threshold) if threshold is not None else top_k(scores, k)
    return [r["feature"] for r in chosen.orderBy(F.col("score").desc_nulls_last(), "feature").collect()]

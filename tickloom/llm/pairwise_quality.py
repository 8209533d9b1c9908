"""Document quality by Bradley-Terry pairwise ranking.

Pairs of a better and a worse training document are preferences; the probability that the first wins is the logistic function of the
difference of their scores, and a score is linear in features of the text (each standardised, and its square). The fit is Newton's method on
the logistic loss of feature differences. The threshold is the quantile of all documents' scores at the share of worse documents among the
training labels; there the score is THRESHOLD.

Null and empty texts count as empty and get the score of their features; repeated rows each give a row. Without preferences (no labels
of one kind) all scores are THRESHOLD.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import held_out, labelled, map_texts, stored

#: Labelled rows that the fit uses at most, preference pairs drawn from them, weight of the squared coefficients, and the score at the quantile.
ROWS, PAIRS, RIDGE, THRESHOLD = 8000, 40_000, 1e-2, 0.3

# Characters counted together.
GROUPS = (b".,", b"!?", b"|", b"#$%&*", b"<>{}[]()=_/\\@^~", b"\"';:-+`", b"0123456789", b"\n", b" \t\r\x0b\x0c")


def features(text: str) -> np.ndarray:
    """Shares of character groups, shape of words and lines, and repetition."""
    body = text.encode()
    size, counts = max(1, len(body)), np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    words, lines = body.split(), [x for x in body.split(b"\n") if x.strip()]
    n, rows = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kinds = counts[counts > 0] / size
    return np.array(
        [
            *(counts[list(g)].sum() / size for g in GROUPS),
            counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum()),
            counts[128:].sum() / size,
            np.log1p(len(words)),
            lengths.mean() if len(words) else 0.0,
            lengths.std() if len(words) else 0.0,
            len(set(words)) / n,
            len(set(zip(words, words[1:], strict=False))) / n,
            np.log(n / rows),
            len(set(lines)) / rows,
            float(-(kinds * np.log(kinds)).sum()),
            (lengths <= 3).sum() / n,
        ]
    )


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z], axis=-1)


class PairwiseRanker:
    """``raw(x)`` scores rows of features; only differences of scores mean anything."""

    def __init__(self, x: np.ndarray, better: np.ndarray, pairs: int = PAIRS, seed: int = 0):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(1), np.ones(1))
        good, bad = np.flatnonzero(better), np.flatnonzero(~better)
        self.weights = np.zeros(2 * x.shape[1] if x.ndim == 2 else 2)
        if len(good) and len(bad):
            rng, z = np.random.default_rng(seed), expanded(x, self.mean, self.scale)
            self.weights = preference_fit(z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.scale) @ self.weights if self.weights.any() else np.zeros(len(x))


def preference_fit(difference: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of winning by ``difference``, with a small ridge."""
    w = np.zeros(difference.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))  # of losing
        slope = RIDGE * w - difference.T @ p / len(difference)
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> PairwiseRanker:
    """Fit on at most ``rows`` labelled rows; only their features reach the driver."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "label": cols["label"], "x": [features(t or "") for t in cols["text"]]}

    found = map_texts(labelled(docs, labels, "quality", rows), "doc_id bigint, label int, x array<double>", make).orderBy("doc_id", "x").toPandas()
    x = np.array(found["x"].tolist()) if len(found) else np.zeros((0, len(features(""))))
    return PairwiseRanker(x, found["label"].to_numpy(int) > 0)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= THRESHOLD) of each whole text."""
    ranker = fit(docs, labels, rows)

    def make():
        def work(cols):
            return {"doc_id": cols["doc_id"], "raw": ranker.raw(np.array([features(t or "") for t in cols["text"]]))}

        return work

    raw = stored(map_texts(docs.select("doc_id", "text"), "doc_id bigint, raw double", make))
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    share = usable.agg(F.avg((F.col("quality") <= 0).cast("double"))).first()[0] or 0.0
    cut = raw.agg(F.percentile_approx("raw", float(share), 100_000)).first()[0] or 0.0
    score = 1 / (1 + F.exp(F.lit(cut) - F.col("raw")) * ((1 - THRESHOLD) / THRESHOLD))
    scored = raw.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round(score, 15).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

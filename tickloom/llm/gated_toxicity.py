"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the vector of its hash and the mean vector of its character n-grams (3 to 5, with the word's ends), so unseen forms of a word
are recognised by their parts. Two gated recurrent units read a window of words from both sides, attention weighs the states, and a linear
output gives the window's logit. A text's logit is the largest of all its overlapping windows.

Training: the label is the document's, the window that counts is its largest one, chosen anew between epochs; the first choice and the first
vector component are log odds of words and n-grams in the training sample. The output is shifted so that 0.5 separates the sample best.

Null and empty texts have one window of padding and get its score; repeated rows each give a row. Without both labels all scores are 0.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import enter, held_out, labelled, map_texts, pieces

#: Labelled rows that the fit uses at most; of these, texts of at most so many bytes.
ROWS, TEXT_BYTES = 4000, 8_000

WINDOW, STRIDE = 32, 20
BUCKETS, SIZE, STATE = 1 << 15, 6, 8
EPOCHS, STEPS, BATCH, DROPPED = 6, 180, 128, 0.4

#: Words whose projections a worker remembers before it starts anew, and windows run at once.
KNOWN_WORDS, TOGETHER = 150_000, 2048

_TRIM = ".,;:!?\"'()[]{}<>|*#$%&_-+=/\\`~^@"


def word_inputs(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Buckets of the words, and for each n-gram length the buckets of n-grams and how many each word has."""
    plain = [w.strip(_TRIM).lower() or w for w in words]
    bodies = [f"<{w}>".encode() for w in plain]
    sizes = np.array([len(b) for b in bodies], np.int64)
    whole = np.array([xxhash.xxh32_intdigest(b) for b in bodies], np.int64) & (BUCKETS - 1)
    data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    first, grams = np.cumsum(sizes) - sizes, []
    for n in (3, 4, 5):
        count = np.maximum(sizes - n + 1, 0)
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        grams.append(((h & np.uint64(BUCKETS - 1)).astype(np.int64), count))
    return whole, grams


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window in the concatenated words, and the number of windows of each text (one at least).

    Windows start every STRIDE words; the last one ends with the text.
    """
    count = np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.repeat(lengths, count)
    return np.repeat(np.cumsum(lengths) - lengths, count) + np.minimum(nth * STRIDE, np.maximum(size - WINDOW, 0)), count


def window_words(numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each window (padding is 0) and the number of windows of each text."""
    starts, count = windows_of(lengths)
    ends = np.repeat(np.cumsum(lengths), count)
    at = starts[:, None] + np.arange(WINDOW)
    padded = np.append(numbers, 0)
    return np.where(at < ends[:, None], padded[np.minimum(at, len(numbers))], 0), count


class GatedNet:
    """Parameters and their use; all arrays are float32 and bounded by the constants above."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        new = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.words, self.grams = (0.1 * rng.normal(0, 1, (BUCKETS, SIZE)).astype(np.float32) for _ in range(2))
        self.p = {"attend": new(2 * STATE, STATE), "attend_bias": np.zeros(STATE, np.float32), "weigh": new(STATE, 1)[:, 0], "out": new(2 * STATE, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": new(2 * SIZE, 3 * STATE), f"in_bias_{d}": np.zeros(3 * STATE, np.float32), f"loop_{d}": new(STATE, 3 * STATE), f"loop_bias_{d}": np.zeros(STATE, np.float32)}
        self.shift = 0.0

    def vectors(self, inputs) -> np.ndarray:
        whole, grams = inputs
        total, n = np.zeros((len(whole), SIZE), np.float32), np.zeros(len(whole), np.int64)
        for buckets, count in grams:
            some = np.flatnonzero(count)
            if len(some):
                total[some] += np.add.reduceat(self.grams[buckets], (np.cumsum(count) - count)[some], axis=0)
            n += count
        return np.concatenate([self.words[whole], total / np.maximum(n, 1)[:, None]], axis=1)

    def projections(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.concatenate([vectors @ self.p[f"in_{d}"] + self.p[f"in_bias_{d}"] for d in "fb"], axis=1)

    def _read(self, table: np.ndarray, words: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, window, STATE) of one direction; ``keep`` gets what the gradient needs."""
        h, out = np.zeros((len(words), STATE), np.float32), np.empty((WINDOW, len(words), STATE), np.float32)
        loop, bias, s, own = self.p[f"loop_{d}"], self.p[f"loop_bias_{d}"], STATE, slice(0, 3 * STATE) if d == "f" else slice(3 * STATE, 6 * STATE)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, back = table[words[:, t]][:, own], h @ loop
            gates = np.tanh((x[:, : 2 * s] + back[:, : 2 * s]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            inner = back[:, 2 * s :] + bias
            new = np.tanh(x[:, 2 * s :] + gates[:, s:] * inner)
            before, h = h, new + gates[:, :s] * (h - new)
            out[t] = h
            if keep is not None:
                keep.append((t, before, gates, inner, new))
        return out

    def logits(self, table: np.ndarray, words: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window of word numbers; ``table`` has the projections by number."""
        if keep is not None:
            keep |= {"f": [], "b": []}
        states = np.concatenate([self._read(table, words, d, keep and keep[d]) if keep is None else self._read(table, words, d, keep[d]) for d in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        energy = hidden @ self.p["weigh"] - np.float32(1e4) * (words.T == 0)
        share = np.exp(energy - energy.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"states": states, "hidden": hidden, "share": share, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def all_logits(self, table: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.concatenate([self.logits(table, words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)])

    def gradients(self, keep: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the parameters, and of the gate inputs (time, window, 6 * STATE); ``slope`` is the loss's by logit."""
        p, g, s = self.p, {}, STATE
        states, hidden, share, pooled = (keep[k] for k in ("states", "hidden", "share", "pooled"))
        g["out"], g["bias"] = pooled.T @ slope, slope.sum(keepdims=True)
        to_pooled = slope[:, None] * p["out"]
        by_share = states @ p["out"] * slope
        to_energy = share * (by_share - (share * by_share).sum(axis=0))
        g["weigh"] = np.tensordot(to_energy, hidden, 2)
        to_hidden = to_energy[:, :, None] * p["weigh"] * (1 - hidden**2)
        g["attend"], g["attend_bias"] = np.tensordot(states, to_hidden, ((0, 1), (0, 1))), to_hidden.sum(axis=(0, 1))
        to_states = share[:, :, None] * to_pooled + to_hidden @ p["attend"].T
        to_inputs = np.empty((*states.shape[:2], 6 * s), np.float32)
        for k, d in enumerate("fb"):
            loop, back = p[f"loop_{d}"], np.zeros((states.shape[1], s), np.float32)
            g[f"loop_{d}"], g[f"loop_bias_{d}"] = np.zeros_like(loop), np.zeros(s, np.float32)
            for t, before, gates, inner, new in reversed(keep[d]):
                to_h = to_states[t, :, k * s : (k + 1) * s] + back
                z, r = gates[:, :s], gates[:, s:]
                to_new = to_h * (1 - z) * (1 - new**2)
                to_gates = np.concatenate([to_h * (before - new) * z * (1 - z), to_new * inner * r * (1 - r)], axis=1)
                to_loop = np.concatenate([to_gates, to_new * r], axis=1)
                to_inputs[t, :, 3 * s * k : 3 * s * k + 2 * s], to_inputs[t, :, 3 * s * k + 2 * s : 3 * s * (k + 1)] = to_gates, to_new
                g[f"loop_{d}"] += before.T @ to_loop
                g[f"loop_bias_{d}"] += (to_new * r).sum(axis=0)
                back = to_h * z + to_loop @ loop.T
            g[f"in_bias_{d}"] = to_inputs[:, :, 3 * s * k : 3 * s * (k + 1)].sum(axis=(0, 1))
        return g, to_inputs


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, slope: np.ndarray) -> None:
        m, v, t = self.seen.get(name, (0.0, 0.0, 0))
        m, v, t = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2, t + 1
        self.seen[name] = m, v, t
        value -= (self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


class _Odds:
    """Log odds of the toxic share of the documents that have a bucket, drawn to 0 where few do."""

    def __init__(self, toxic: np.ndarray):
        self.toxic, self.have = toxic, np.zeros((2, BUCKETS))

    def add(self, docs: np.ndarray, buckets: np.ndarray) -> None:
        """Some documents' buckets; no document may come twice."""
        pairs = np.unique(docs * BUCKETS + buckets)
        toxic = self.toxic[pairs // BUCKETS]
        self.have += np.bincount(pairs % BUCKETS, toxic, BUCKETS), np.bincount(pairs % BUCKETS, 1 - toxic, BUCKETS)

    def odds(self) -> np.ndarray:
        share = self.have / np.maximum([[self.toxic.sum()], [(1 - self.toxic).sum()]], 1) + 3 / max(1, self.toxic.sum())
        return np.clip(np.log(share[0] / share[1]), -3, 5).astype(np.float32)


def _chosen(inputs, ids: np.ndarray):
    """The inputs of some of the words."""
    whole, grams = inputs
    first = lambda c: np.repeat((np.cumsum(c) - c)[ids] - (np.cumsum(c[ids]) - c[ids]), c[ids])
    return whole[ids], [(b[first(c) + np.arange(c[ids].sum())], c[ids]) for b, c in grams]


def _in_parts(net: GatedNet, inputs, make) -> np.ndarray:
    """``make`` of the vectors of all words, so many at a time."""
    n = len(inputs[0])
    return np.concatenate([make(net.vectors(_chosen(inputs, np.arange(i, min(n, i + 20_000))))) for i in range(0, n, 20_000)])


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> GatedNet | None:
    """A fitted network, or None without both labels."""
    toxic = np.asarray(toxic, float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    rng, net = np.random.default_rng(seed), GatedNet(seed)
    split = [t.split() for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for x in split for w in x), 1)}
    lengths = np.array([len(x) for x in split], np.int64)
    numbers = np.array([number[w] for x in split for w in x], np.int64)
    whole, grams = inputs = _joined([word_inputs(part) for part in _split([" ", *number])])  # number 0 is padding
    del split, number
    word_odds, gram_odds, ends = _Odds(toxic), _Odds(toxic), np.cumsum(lengths)
    for i in range(0, len(texts), 100):  # so many documents at a time
        begin, end = ends[i] - lengths[i], ends[min(i + 100, len(texts)) - 1]
        pairs = np.unique(np.repeat(np.arange(i, min(i + 100, len(texts))), lengths[i : i + 100]) * len(whole) + numbers[begin:end])
        doc, word = pairs // len(whole), pairs % len(whole)
        own_words, own_grams = _chosen(inputs, word)
        word_odds.add(doc, own_words)
        gram_odds.add(np.concatenate([np.repeat(doc, c) for _, c in own_grams]), np.concatenate([g for g, _ in own_grams]))
    net.words[:, 0], net.grams[:, 0] = word_odds.odds(), gram_odds.odds()
    words, count = window_words(numbers, lengths)
    first = np.cumsum(count) - count
    score = _in_parts(net, inputs, lambda v: v[:, 0] + 2 * v[:, SIZE])[words].max(axis=1)

    def best(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(score)), score, np.repeat(np.arange(len(count)), count)))
        return order[first + count - 1]

    dense, sparse = _Adam(0.01), {"words": np.full(BUCKETS, 1e-3), "grams": np.full(BUCKETS, 1e-3)}
    weight = np.where(toxic > 0, min(4.0, (1 - toxic).sum() / toxic.sum()), 1.0)
    batches = -(-len(toxic) // BATCH)
    epochs, chosen = max(epochs, -(-STEPS // batches)), best(score)
    for epoch in range(epochs):
        if epoch == epochs // 3:
            chosen = best(net.all_logits(_in_parts(net, inputs, net.projections), words))
        for rows in np.array_split(rng.permutation(len(toxic)), batches):
            used, local = np.unique(words[chosen[rows]], return_inverse=True)
            local = local.reshape(-1, WINDOW)
            zero = used[0] == 0
            local = local if zero else local + 1
            ids = used if zero else np.append(0, used)
            parts = _chosen(inputs, ids)
            x, keep = net.vectors(parts), {}
            alone = rng.random(len(x)) < DROPPED  # these words are known by their n-grams alone, as unseen words will be
            x[alone, :SIZE] = 0
            logit = net.logits(net.projections(x), local, keep)
            slope = ((1 / (1 + np.exp(-logit)) - toxic[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g, to_inputs = net.gradients(keep, slope)
            by_word = np.zeros((len(ids), 6 * STATE), np.float32)
            np.add.at(by_word, local.T.reshape(-1), to_inputs.reshape(-1, 6 * STATE))
            to_x = by_word[:, : 3 * STATE] @ net.p["in_f"].T + by_word[:, 3 * STATE :] @ net.p["in_b"].T
            g["in_f"], g["in_b"] = x.T @ by_word[:, : 3 * STATE], x.T @ by_word[:, 3 * STATE :]
            n = np.maximum(sum(c for _, c in parts[1]), 1)
            for name, table, buckets, slopes in (
                ("words", net.words, parts[0], to_x[:, :SIZE] * ~alone[:, None]),
                ("grams", net.grams, np.concatenate([b for b, _ in parts[1]]), np.concatenate([np.repeat(to_x[:, SIZE:] / n[:, None], c, axis=0) for _, c in parts[1]])),
            ):
                at, where = np.unique(buckets, return_inverse=True)
                total = np.zeros((len(at), SIZE), np.float32)
                np.add.at(total, where, slopes)
                sparse[name][at] += (total**2).mean(axis=1)
                table[at] -= (0.05 * total / np.sqrt(sparse[name][at])[:, None]).astype(np.float32)
            for name, value in net.p.items():
                dense.step(name, value, g[name])
    logits = np.maximum.reduceat(net.all_logits(_in_parts(net, inputs, net.projections), words), first)
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(toxic) + 1) + toxic.sum())
    k = int(f1.argmax())
    following = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    net.shift = float((logits[order[k]] + following) / 2)
    return net


def _split(words: list[str], size: int = 20_000) -> list[list[str]]:
    return [words[i : i + size] for i in range(0, len(words), size)]


def _joined(parts: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The inputs of several lists of words one after the other; buckets are small numbers."""
    grams = [tuple(np.concatenate([p[1][k][j] for p in parts]).astype(np.int32) for j in (0, 1)) for k in range(3)]
    return np.concatenate([p[0] for p in parts]), grams


class TextScorer:
    """Scores texts; remembers the projections of words."""

    def __init__(self, net: GatedNet):
        self.net, self.number = net, {}
        self.table = np.zeros((1, 6 * STATE), np.float32)
        self.forget()

    def forget(self) -> None:
        self.number.clear()
        self.table = self.net.projections(self.net.vectors(word_inputs([" "])))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of the texts. One text's words are held at a time; of the others only their numbers."""
        if len(self.number) > KNOWN_WORDS:
            self.forget()
        seen: set[str] = set()
        for t in texts:
            seen.update(t.split())
        new = list(seen.difference(self.number))
        del seen
        if new:
            done = len(self.table)
            self.number.update(zip(new, range(done, done + len(new)), strict=True))
            grown = np.empty((done + len(new), 6 * STATE), self.table.dtype)
            grown[:done], self.table = self.table, grown
            for part in _split(new):
                grown[done : done + len(part)] = self.net.projections(self.net.vectors(word_inputs(part)))
                done += len(part)
        at = self.number.__getitem__
        numbers = [np.array(list(map(at, t.split())), np.int64) for t in texts]
        words, count = window_words(np.concatenate(numbers), np.array([len(x) for x in numbers], np.int64))
        logits = np.maximum.reduceat(self.net.all_logits(self.table, words), np.cumsum(count) - count)
        return 1 / (1 + np.exp(-(logits.astype(float) - self.net.shift)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, text_bytes: int = TEXT_BYTES) -> GatedNet | None:
    """Train on at most ``rows`` labelled rows, without texts of more than ``text_bytes``; their texts reach the driver."""
    sample = labelled(docs, labels, "toxic", rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").filter(F.octet_length("text") <= text_bytes)
    found = sample.orderBy("doc_id", "text").toPandas()
    return train(found["text"].tolist(), found["label"].to_numpy(int) > 0)


def _scorer(net: GatedNet | None):
    if net is None:
        return lambda texts: np.zeros(len(texts))
    return TextScorer(net).scores


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def make():
        scores = _scorer(shared.value)

        def work(cols):
            found = scores([t or "" for t in cols["text"]])
            return {"doc_id": cols["doc_id"], "score": found, "predicted": (found >= 0.5).astype("i4")}

        return work

    found = map_texts(docs.select("doc_id", "text"), "doc_id bigint, score double, predicted int", make)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    shared, at, schema = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows)), docs.columns.index("text"), docs.schema

    def run(batches):
        enter(__name__)
        scores = _scorer(shared.value)
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(scores([t or "" for t in part.column(at).to_pylist()]) < 0.5)

    return docs.mapInArrow(run, schema)

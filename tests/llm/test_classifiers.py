import zlib

import numpy as np
import pytest

from tickloom.llm import gated_toxicity as tox
from tickloom.llm import pairwise_quality as pq

DOCS = "doc_id bigint, text string, score double, label string, k1 int"
LABELS = "doc_id bigint, quality int, toxic int, text string"
WORDS = "river stone under morning letter carry window slowly people garden between answer paper music".split()


def corpus(n=240, seed=0):
    rng, docs, labels = np.random.default_rng(seed), [], []
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(5, 120)))
        bad = i % 4 == 0
        if bad:
            words[rng.integers(len(words))] = "grub" + "".join(rng.choice(list("aeiou"), 3))  # a word family, its forms mostly unseen
        junk = i % 3 == 0
        text = " ".join(w + "##$$" if junk else w for w in words)
        docs.append((i, text, 0.5, "x", 1))
        labels.append((i, int(not junk), int(bad), "t"))
    return docs, labels


EDGE = [(None, "river stone", None, None, None), (1000, None, None, None, None), (1001, "", 1.0, "", 0), (1002, " ".join(WORDS) * 3000, 1.0, "", 0), (0, "again", 0.0, "", 0), (0, "again", 0.0, "", 0)]
ODD_LABELS = [(None, 1, 1, ""), (5, None, None, ""), (7, 1, 0, ""), (7, 1, 0, ""), (999_999, 0, 1, None)]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs + EDGE, DOCS), spark.createDataFrame(labels + ODD_LABELS, LABELS), docs, labels


def test_gradients_equal_differences():
    rng, net = np.random.default_rng(1), tox.GatedNet(1)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in net.p.items()}
    table, words, want = rng.normal(size=(9, 6 * tox.STATE)), rng.integers(0, 9, (4, tox.WINDOW)), rng.normal(size=4)
    keep = {}
    net.logits(table, words, keep)
    g, to_inputs = net.gradients(keep, want)
    loss = lambda: float(net.logits(table, words) @ want)
    for name in ("attend", "attend_bias", "weigh", "out", "bias", "loop_f", "loop_b", "loop_bias_f", "loop_bias_b"):
        at = tuple(rng.integers(n) for n in net.p[name].shape)
        old, step = net.p[name][at], 1e-3
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - np.asarray(g[name])[at]) < 2e-3, name
    by_word = np.zeros_like(table)
    np.add.at(by_word, words.T.reshape(-1), to_inputs.reshape(-1, 6 * tox.STATE))
    for at in [(3, 1), (4, 12), (5, 30), (2, 45)]:
        old = table[at]
        table[at] = old + 1e-3
        up = loss()
        table[at] = old - 1e-3
        down = loss()
        table[at] = old
        assert abs((up - down) / 2e-3 - by_word[at]) < 2e-3


def test_windows_cover_each_text():
    lengths = np.array([0, 1, 32, 33, 52, 53, 200])
    words, count = tox.window_words(np.arange(1, lengths.sum() + 1), lengths)
    first, begin = np.cumsum(count) - count, np.cumsum(lengths) - lengths
    for i, n in enumerate(lengths):
        own = words[first[i] : first[i] + count[i]]
        assert set(own[own > 0].tolist()) == set(range(begin[i] + 1, begin[i] + n + 1))
        assert all((w > 0).all() for w in own) or n < tox.WINDOW
        assert all(b[0] - a[0] <= tox.STRIDE for a, b in zip(own, own[1:], strict=False))


def test_toxicity(tables, spark):
    docs, labels, rows, marks = tables
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(EDGE)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {m[0]: m[2] for m in marks}
    held = [(toxic[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in toxic and r.doc_id]
    assert np.mean([a == b for a, b in held]) > 0.9
    kept = tox.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(-1 if r.doc_id is None else r.doc_id for r in got if not r.predicted)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in tox.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_preference_fit_finds_the_best_weights():
    rng = np.random.default_rng(0)
    d = rng.normal(0, 1, (500, 4)) + 0.3
    loss = lambda w: float(np.log1p(np.exp(-d @ w)).mean() + pq.RIDGE / 2 * w @ w)
    w = pq.preference_fit(d)
    assert all(loss(w) <= loss(w + e) for e in rng.normal(0, 0.05, (200, 4)))


def test_quality(tables, spark):
    docs, labels, rows, marks = tables
    got = pq.score_quality(docs, labels).collect()
    assert len(got) == len(rows) + len(EDGE)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= pq.THRESHOLD) for r in got)
    quality = {m[0]: m[1] for m in marks}
    assert np.mean([quality.get(r.doc_id) == r.predicted for r in got if r.held_out and r.doc_id in quality and r.doc_id]) > 0.9
    assert pq.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in pq.score_quality(docs, labels.limit(0)).collect()} == {0.3}


def test_scorer_holds_the_words_of_one_text():
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, 2700, 10)] * 2 + [""]
    scorer = tox.TextScorer(tox.GatedNet(1))
    want = scorer.scores(texts[:270])
    tracemalloc.start()
    got = scorer.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[:270], want, rtol=1e-5) and np.allclose(got[270:540], want, rtol=1e-5)
    print(peak)
    assert peak < 20e6


def test_known_pieces_of_the_automaton_are_bounded():
    from tickloom.llm import bpe_automaton

    encoder, _ = bpe_automaton._worker(bpe_automaton.VOCABULARY)
    assert encoder.most + bpe_automaton.KNOWN_WORDS <= 300_000

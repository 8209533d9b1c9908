import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import suffix_repeats as sr

SCHEMA = "doc_id bigint, text string, id int, spans string, n_chars bigint"


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), len(sr.runs(gone)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80) | st.lists(st.sampled_from([0, 1, 2]), max_size=80).map(bytes))
def test_two_stage_order_is_the_suffix_order(data):
    got = sr.two_stage_order(np.frombuffer(data, np.uint8), 200)
    assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\0", min_size=4, max_size=30), max_size=8))
def test_repeated_starts(texts):
    bodies = [t.encode() for t in texts]
    times = Counter(b[i : i + 4] for b in bodies for i in range(len(b) - 3))
    got = sr.repeated_starts(bodies, 4)
    assert [g.tolist() for g in got] == [[times[b[i : i + 4]] > 1 for i in range(len(b) - 3)] for b in bodies]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120) | st.lists(st.sampled_from([0, 1]), max_size=120).map(bytes))
def test_equal_strings_have_equal_anchors(data):
    first, last, at, own, whole = sr.anchors(np.frombuffer(data, np.uint8), 12, 4)
    seen = {}
    for f, z, a, h in zip(first, last, at, own, strict=True):
        for p in range(f, z + 1):
            assert p <= a <= p + 8
            assert seen.setdefault(data[p : p + 12], (a - p, h)) == (a - p, h)
    assert [p for f, z in zip(first, last, strict=True) for p in range(f, z + 1)] == list(range(max(0, len(data) - 11)))


def corpus():
    rng = np.random.default_rng(5)
    words = ["alpha", "béta", "gamma", "d", "漢字", "longerword", "\0x"]
    text = lambda n: " ".join(rng.choice(words, n)) + str(rng.integers(1 << 40))
    shared, hot = text(30), text(25)
    texts = [text(rng.integers(1, 60)) for _ in range(40)]
    texts += [text(10) + shared[: rng.integers(60, 200)] + text(10) for _ in range(12)]
    texts += [text(5) + hot + text(5) for _ in range(40)] + [hot * 3, "a" * 500, "a" * 300, "ab" * 200]
    texts += [texts[0]] * 3 + ["", None, "short", "short"] + [text(4000)] * 2 + [text(3000)]
    return texts


@pytest.mark.parametrize("together", [3000, 3])
def test_removal(spark, together):
    texts = corpus()
    rows = [(i if i else None, t, 1, "s", 7) for i, t in enumerate(texts)] + [(5, texts[5], 0, "", 0), (6, "same id " * 9, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(sr.removal_digests(df, 40, 16, together).collect())
    want = Counter((r[0], n, k, m, hashlib.sha256(b).hexdigest()) for r, (n, k, m, b) in zip(rows, brute([r[1] for r in rows], 40), strict=True))
    assert got == want
    if together == 3:
        left = sr.without_repeats(df, 40, 16)
        assert left.columns == df.columns
        kept = Counter((r.doc_id, r.text) for r in left.collect())
        assert kept == Counter((r[0], None if r[1] is None else b.decode("utf-8", "ignore")) for r, (*_, b) in zip(rows, brute([r[1] for r in rows], 40), strict=True))
        assert all(r.text is None or r.n_chars == len(r.text) or r.n_chars in (7, 0, None) for r in left.collect())


def test_production_length(spark):
    base = "".join(chr(97 + i * i * 7 % 26) for i in range(900)) + "".join(str(i) for i in range(300))
    texts = ["x" + base[:199] + "y", "z" + base[:199] + "w", "p" + base[300:500] + "q", "r" + base[300:500] + "s", base[600:1000], base[700:1100]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sr.removal_digests(df).collect()}
    assert got == {i: (n, k, m, hashlib.sha256(b).hexdigest()) for i, (n, k, m, b) in enumerate(brute(texts, 200))}


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sr.removal_digests(df).count() == 0 and sr.without_repeats(df).count() == 0

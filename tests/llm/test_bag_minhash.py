from collections import Counter

import numpy as np
import pytest

from tickloom.llm import bag_minhash as bm

SCHEMA = "doc_id bigint, text string, node string, class string, key int"


def bag(text):
    words = text.split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def brute_classes(rows):
    """Row number to the smallest (id, text) of its class."""
    keys = sorted({(r[0], r[1] or "") for r in rows}, key=lambda k: (k[0] is not None, k))
    texts = sorted({t for _, t in keys})
    group = {t: t for t in texts}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    bags = {t: bag(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if jaccard(bags[a], bags[b]) >= 0.8:
                group[root(a)] = root(b)
    return {k: root(k[1]) for k in keys}


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(names, n)) for n in rng.integers(20, 200, 40)]
    for base in texts[:12]:
        for edits in (1, 1, 2, 3):
            words = base.split()
            for _ in range(edits):
                words[rng.integers(len(words))] = "edited"
            texts.append(" ".join(words))
    passage = " ".join(rng.choice(names, 120))
    texts += [passage + " " + " ".join(rng.choice(names, 60)) for _ in range(25)]  # alike, below the threshold
    hot = " ".join(rng.choice(names, 150))
    texts += [hot + f" tail{i}" for i in range(60)]
    texts += ["same again"] * 7 + ["", "", " ", "one", "one two three", "a b c d e " * 40, "a b c d e " * 37, "x " * 9000, "x " * 8000]
    return texts


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(3)
    for weights in ((1, 2), (1, 9), (5, 40)):
        a = Counter({int(k): int(v) for k, v in zip(range(60), rng.integers(*weights, 60), strict=True)})
        b = Counter({int(k): int(v) for k, v in zip(range(20, 80), rng.integers(*weights, 60), strict=True)})
        bags = [(bm.mixed(np.array(sorted(x), np.uint64)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        s = bm.signatures(bags, 4096)
        assert abs(float((s[0] == s[1]).mean()) - jaccard(a, b)) < 0.035


def test_signatures_do_not_depend_on_company():
    bags = [bm.shingle_bag(t) for t in corpus()]
    together = bm.signatures(bags, 120)
    assert all((bm.signatures([b], 120)[0] == together[i]).all() for i, b in enumerate(bags) if i % 7 == 0)


@pytest.mark.parametrize("parts", [1, 5])
def test_classes_equal_brute_force(spark, parts):
    texts = corpus()
    rows = [(i, t, "n", "c", 1) for i, t in enumerate(texts)] + [(3, texts[3], "n", "other", 2), (5, "a wholly different text", "", "", 0), (None, texts[0], None, None, None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = bm.near_duplicates(df).collect()
    want = brute_classes(rows)
    least = {}
    for (i, _), c in want.items():
        least[c] = min(least.get(c, (True, 1 << 62)), (i is not None, i or 0))
    plain = lambda x: None if not x[0] else x[1]
    expected = Counter((r[0], plain(least[want[r[0], r[1] or ""]])) for r in rows)
    assert Counter((r.doc_id, r.class_id) for r in got) == expected
    assert sum(r.kept for r in got) == len(set(want.values()))
    kept = bm.without_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(want[r.doc_id, r.text or ""] for r in kept.collect()) == Counter(set(want.values()))


def test_dissimilar_nodes_that_share_a_key_lose_no_link(spark):
    """Candidates given by hand: one key with unlike nodes, chains and pairs that a leader is not part of."""
    base = [f"t{i}" for i in range(200)]
    chain = [" ".join(base[:-1 - 4 * k] + [f"c{k}_{j}" for j in range(4 * k)]) for k in range(12)]
    other = [" ".join(f"u{g}_{i}" for i in range(100)) + extra for g in range(6) for extra in ("", " x", " y z")]
    texts = chain + other
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("node", bm.text_node(bm.F.col("text")))
    classes = bm.node_classes(df.select(bm.F.lit(1).alias("key"), "node"), df.select("node", "text"))
    got = {r.doc_id: bytes(r["class"]) if r["class"] else None for r in df.join(classes, "node", "left").collect()}
    want = brute_classes([(i, t) for i, t in enumerate(texts)])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert (got[i] is not None and got[i] == got[j]) == (want[i, a] == want[j, b])


def test_a_key_of_many_alike_nodes(spark, monkeypatch):
    """Copies that differ from each other more than from their origin: one class by way of few comparisons."""
    compared, similarities = [], bm.similarities

    def counted(pairs, texts, words):
        compared.append(pairs.count())
        return similarities(pairs, texts, words)

    monkeypatch.setattr(bm, "similarities", counted)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words)]
    for k in range(150):
        own = list(words)
        for j in range(2):
            own[rng.integers(len(own))] = f"e{k}_{j}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("node", bm.text_node(bm.F.col("text")))
    shared = df.select("node", bm.F.explode(bm.F.sequence(bm.F.lit(1), bm.F.lit(6))).alias("key"), "doc_id").filter("doc_id = 0 OR (pmod(xxhash64(doc_id, key), 10) < 4 AND key != doc_id % 6 + 1)")
    classes = bm.node_classes(shared.select("key", "node"), df.select("node", "text")).collect()
    want = brute_classes(list(enumerate(texts)))
    assert len({r["class"] for r in classes}) == len(set(want.values())) == 1 and len(classes) == shared.select("node").distinct().count()
    assert sum(compared) < 2 * len(texts)


def paths(count):
    """Paths of four texts in which only neighbours are similar enough; texts of different paths are unlike."""
    return [" ".join([f"p{g}_{i}" for i in range(16 * k, 16 * k + 200)]) for g in range(count) for k in range(4)]


@pytest.mark.parametrize("most", [2000, 9])
def test_links_between_nodes_of_different_leaders(spark, monkeypatch, most):
    """Twelve paths share a key, so two middle nodes may each be linked to an end that leads; with small parts these are dealt over several tasks."""
    monkeypatch.setattr(bm, "PART_ROWS", most)
    monkeypatch.setattr(bm, "LEADERS", 2)
    texts = paths(96)
    assert jaccard(bag(texts[0]), bag(texts[1])) >= 0.8 > jaccard(bag(texts[0]), bag(texts[2]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("node", bm.text_node(bm.F.col("text")))
    classes = bm.node_classes(df.selectExpr("doc_id div 48 AS key", "node"), df.select("node", "text"))
    got = {r.doc_id: bytes(r["class"]) for r in df.join(classes, "node").collect()}
    assert len(got) == len(texts) and len(set(got.values())) == 96
    assert all(got[i] == got[i - i % 4] for i in got)


def test_common_units_are_the_smaller_counts():
    bags = [bm.shingle_bag(t) for t in corpus()[:60] + corpus()[-9:]]
    a, b = bags[:50], bags[30:]
    common = bm.common_units([bm.units(x) for x in a], [bm.units(y) for y in b])
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            total = x[1].sum() + y[1].sum() - common[i, j]
            assert (common[i, j] / total if total else 0.0) == bm.weighted_jaccard(x, y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200), (300, 301), (300, 301)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.node: r["class"] for r in bm.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 300: 300, 301: 300} | {500 + i: 500 for i in range(40)}
    assert got == want


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bm.near_duplicates(df).count() == 0 and bm.without_duplicates(df).count() == 0

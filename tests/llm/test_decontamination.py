import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import decontamination as dc

DOCS = "doc_id bigint, text string, item_id int, score string"
ITEMS = "item_id bigint, text string, doc_id string"


def brute_score(item, words):
    if not item:
        return 0.0
    best, above = 0, [0] * (len(words) + 1)
    for a in item:
        row = [0] * (len(words) + 1)
        for j, b in enumerate(words, 1):
            row[j] = max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, row[j - 1] - 1)
            best = max(best, row[j])
        above = row
    return best / (2 * len(item))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=25))
def test_alignment_equals_the_full_table(item, words):
    score, end = dc.best_alignment(np.array(item, np.uint64), np.array(words, np.uint64))
    assert score == brute_score(item, words)
    if score:
        assert brute_score(item, words[: end + 1]) == score


def corpus():
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    text = lambda n: list(rng.choice(names, n))
    items = [text(n) for n in (15, 20, 30, 45, 60, 12)] + [["one", "two"], []]
    docs = [" ".join(text(rng.integers(0, 150))) for _ in range(40)]
    for i, item in enumerate(items[:6]):
        exact = " ".join(text(30) + item + text(30))
        edited = list(item)
        for k in range(3, len(edited), 9):
            edited[k] = "changed"
        half = item[: len(item) // 4]
        docs += [exact, ("Intro. " + " ".join(edited).upper().replace(" ", ", ") + "! " + " ".join(text(20))), " ".join(text(10) + half + text(10))]
        docs += [" ".join(text(8) + item[: len(item) // 2] + ["extra", "words"] + item[len(item) // 2 :])]
        if i == 0:
            docs += [f"{k} copies " + " ".join(item) for k in range(50)]
    return items, docs + ["", None, " ".join(items[3]) + " x" * 20_000]


def test_leaks_equal_brute_force(spark):
    items, docs = corpus()
    rows = [(i, t, 1, "s") for i, t in enumerate(docs)] + [(None, docs[40], None, None), (41, docs[41], 0, "")]
    marks = [(i, " ".join(w), "x") for i, w in enumerate(items)] + [(0, " ".join(items[0]), "x"), (9, None, None)]
    df, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(marks, ITEMS)
    want = set()
    for i, t, *_ in rows:
        words = dc.word_numbers((t or "").replace(" x" * 100, "")).tolist()
        for k, item in enumerate(items):
            score = brute_score(dc.word_numbers(" ".join(item)).tolist(), words) if len(item) >= 4 else 0
            if score >= 0.5:
                want.add((i, k, round(score, 9)))
    got = dc.leaked_items(df, bench).collect()
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in got} == want and len(want) > 60
    small = dc.leaks(df, bench, table_grams=50).collect()
    assert {(None if r.id == -(1 << 63) else r.id, r.item_id, round(r.score, 9)) for r in small} == want
    kept = dc.without_leaks(df, bench)
    assert kept.columns == df.columns
    leaked = {w[0] for w in want}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in leaked)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.lists(st.integers(0, 20), max_size=80), st.sampled_from([0.3, 0.5, 0.8]))
def test_pairs_that_are_not_aligned_cannot_leak(item, words, threshold):
    if not dc.can_leak(np.array(item, np.uint64), np.array(words, np.uint64), threshold):
        assert brute_score(item, words) < threshold


def test_edited_copies_beside_exact_ones(spark):
    rng = np.random.default_rng(5)
    items = [[f"i{i}w{k}" for k in range(24 + i % 20)] for i in range(40)]
    docs = [" ".join(item) for item in items for _ in range(3)]
    edits = {}
    for i, item in enumerate(items):
        for step in (4, 5, 6, 7):
            for first in range(step):
                edits[len(docs)] = i
                docs.append(" ".join("other" if k % step == first else w for k, w in enumerate(item)))
        for share in (0.2, 0.25):
            edited = [w if rng.random() > share else "other" for w in item]
            words = [dc.word_numbers(" ".join(x)).tolist() for x in (item, edited)]
            if brute_score(*words) >= 0.5 and any("other" not in edited[k : k + 3] for k in range(len(item) - 2)):
                edits[len(docs)] = i
                docs.append(" ".join(edited))
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in dc.leaked_items(df, bench).collect()}
    assert got == set(edits.items()) | {(k, k // 3) for k in range(120)}


def test_rows_without_id_whose_texts_share_a_short_hash(spark):
    numbered = lambda text, name: spark.range(200_000).select(F.concat(F.lit(text), "id").alias(name), F.hash(F.concat(F.lit(text), "id")).alias("h"))
    same = numbered("a b c d e f g h ", "leaky").join(numbered("nothing of it here ", "clean"), "h").select("leaky", "clean").first()
    df, bench = spark.createDataFrame([(None, same.leaky, 1, ""), (None, same.clean, 2, "")], DOCS), spark.createDataFrame([(1, "a b c d e f g h", "")], ITEMS)
    assert [r.item_id for r in dc.leaked_items(df, bench).collect()] == [1]
    assert [r.text for r in dc.without_leaks(df, bench).collect()] == [same.clean]


def test_no_rows(spark):
    df, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f g", "")], ITEMS)
    assert dc.leaked_items(df, bench).count() == 0 and dc.without_leaks(df, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g", 1, "")], DOCS)
    assert dc.leaked_items(some, bench.limit(0)).count() == 0 and dc.without_leaks(some, bench.limit(0)).count() == 1

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import fertility

SCHEMA = "doc_id bigint, text string, lang string, language string, kept int"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#c", "é", "\n", " ", "\t", "\r", "\x85", " ", "|", "a b a b a\n"]), max_size=60).map(" ".join))
def test_base_counts(text):
    counter = fertility._worker(fertility.PIECES, fertility.RANKS)
    words = text.encode().split()
    counter.learn(set(words))
    assert counter.measure(text.encode(), words)[:5] == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_repeated_words_by_any_numbers(numbers):
    windows = [tuple(numbers[i : i + 5]) for i in range(len(numbers) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    assert fertility.repeated_words(np.array(numbers, int)) == len(inside)


def test_repeated_words_with_many_words():
    numbers = np.concatenate([np.arange(60_000), np.arange(100, 107)])
    assert fertility.repeated_words(numbers) == 14


def test_measures_of_a_text():
    import sentencepiece

    text = "ordinary text, and 漢字 too"
    counter = fertility._worker(fertility.PIECES, fertility.RANKS)
    words = text.encode().split()
    counter.learn(set(words))
    *_, per_piece, per_token, byte_share, entropy = counter.measure(text.encode(), words)
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.PIECES)
    ids = [i for w in text.split() for i in model.encode(w)]
    assert per_piece == sum(map(len, text.split())) / len(ids)
    assert byte_share == sum(model.is_byte(i) for i in ids) / len(ids)
    assert per_token == sum(map(len, text.split())) / sum(len(counter.ranks.encode_ordinary(" " + w)) for w in text.split())
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert np.isclose(entropy, -(share * np.log(share)).sum() / np.log(len(ids)))


def test_quality_rules(spark):
    rng = np.random.default_rng(1)
    names = "river stone under morning letter carry window slowly people garden between answer".split()
    rows = [(i, " ".join(rng.choice(names, 40)), "en", "x", 1) for i in range(60)]
    odd = [(100, "漢字" * 30 + " ñ字" * 39, "en", None, 0), (101, " ".join("q%dx#Zk" % i for i in range(40)), "en", None, 0), (102, None, None, None, None), (103, "", "en", "", 1)]
    rows += odd + [rows[0], (None, rows[1][1], None, None, None), (104, "again and again it goes\n" * 20, "en", None, 0), (105, "word%d " * 1 % 7 * 5000, "fr", None, None)]
    got = fertility.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *[r[c] for c in BASE]) for r in got) == sorted((-1 if r[0] is None else r[0], *brute(r[1])) for r in rows if r[0] != 105) + [(105, *[r[c] for c in BASE]) for r in got if r.doc_id == 105]
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in (100, 101, 102, 103, 104, 105))
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    few = [(i, " ".join(rng.choice(names, 12)), "sv", None, None) for i in range(200, 203)]
    assert all(r.kept for r in fertility.quality_rules(spark.createDataFrame(rows + few, SCHEMA)).collect() if r.language == "sv")
    assert {r.language for r in got if r.doc_id is None} == {"Latin"}
    assert "byte_share" in next(r.rejected_by for r in got if r.doc_id == 100)
    assert fertility.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fertility.quality_rules(spark.createDataFrame(rows, SCHEMA).drop("lang")).count() == len(rows)


def test_short_junk_in_a_filled_group_is_rejected(spark):
    rng = np.random.default_rng(3)
    names = "river stone under morning letter carry window slowly people garden between answer".split()
    plain = lambda n: list(rng.choice(names, n))
    for rows, rejected in ((300, True), (3, False)):
        docs = [(i, " ".join(plain(40)), "en", None, None) for i in range(rows)]
        junk = [(1000, " ".join(plain(38) + ["\ue001\ue002", "\ue003\ue004"]), "en", None, None)]
        got = {r.doc_id: r for r in fertility.quality_rules(spark.createDataFrame(docs + junk, SCHEMA)).collect()}
        assert 0.13 < got[1000].byte_share < 0.3 and not got[1000].base_failed
        assert ("byte_share" in got[1000].rejected_by) is rejected
        assert all(got[i].kept for i in range(rows))

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import license_templates as lic
from tickloom.llm import longest_match as lm

SCHEMA = "doc_id bigint, text string, part string, labels string"


def by_template(words, template):
    """All accepted spans, with the template written as a regular expression over words."""
    pattern = ""
    for i, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2 == 0:
            pattern += "".join(re.escape(w) + " " for w in re.findall(r"[0-9a-z]+", part.lower()))
        elif part == "beginOptional":
            pattern += "(?:"
        elif part == "endOptional":
            pattern += ")?"
        else:
            least, most = re.search(r"words=(\d+)-(\d+)", part).groups()
            pattern += rf"(?:[^ ]+ ){{{least},{most}}}"
    text = "".join(w + " " for w in words)
    starts = [0] + [m.end() for m in re.finditer(" ", text)][:-1]
    return any(re.compile(pattern).match(text, s) for s in starts)


SMALL = {"a": "x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> w", "b": "x <<var;name=n;original=o;words=1-3>> y", "c": "z z <<beginOptional>>x<<endOptional>>"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("xyzwv"), max_size=12))
def test_automata_accept_what_the_template_means(words):
    automata = [(k, lic.TemplateAutomaton(t)) for k, t in SMALL.items()]
    n, *_, labels, score, _ = lic.scan_text(" ".join(words), [], automata)
    assert n == len(words)
    assert labels == ",".join(k for k, t in SMALL.items() if by_template(words, t))
    assert 0 <= score <= 1 and (score == 1) == bool(labels)


def test_templates_that_make_no_sense():
    for bad in ("<<beginOptional>>x<<endOptional>>", "<<beginOptional>>x y", "<<var;name=a;original=b;words=1-2>> x"):
        with pytest.raises(ValueError):
            lic.TemplateAutomaton(bad)


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "x y. Licensed under CC BY-NC 4.0.\nAll rights RESERVED. cc-by cc by": "cc-by,cc-by-nc-4.0,reserved",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0": "apache-2.0,mit",
    "Licensed under the Apache License, version 3": "",
    "Copyright (c) 2020 Some Body. All rights reserved.": "copyright-notice,reserved",
    "éall rights reserved ÉALL rights reserved": "",
    None: "",
    "": "",
    " \n": "",
    "all rights reserved " * 5000: "reserved",
}


def test_scan(spark):
    rows = [(i, t, "p", "q") for i, t in enumerate(TEXTS)] + [(0, next(iter(TEXTS)), None, None), (None, "cc by", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lic.scan_licenses(df).collect()}
    assert got == {(i, *brute(t)) for i, t, *_ in rows}
    labels = {r.doc_id: (r.labels, r.score) for r in lic.scan_licenses(df).collect()}
    assert [labels[i][0] for i in range(len(TEXTS))] == list(TEXTS.values())
    assert 0.5 < labels[3][1] < 1 and labels[2][1] == 1 and labels[6][1] == 0
    assert lic.scan_licenses(df.limit(0)).count() == 0


def greedy(word, vocabulary):
    n = b = i = 0
    while i < len(word):
        size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in vocabulary), 0)
        if size:
            n, i = n + 1, i + size
        else:
            n, b, i = n + len(word[i].encode()), b + len(word[i].encode()), i + 1
    return n, b


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=5), max_size=12), st.text("abéz", max_size=14))
def test_counts_equal_greedy_matching(vocabulary, word):
    n = lm.LongestMatch(sorted(vocabulary)).count(word)
    assert (n % lm.BYTE_TOKEN, n // lm.BYTE_TOKEN) == greedy(word, vocabulary)


def test_count_tokens(spark):
    texts = ["", None, "hello world", "👩‍👩‍👧 ünïcode \x00 漢字", " \n ", "antidisestablishment " * 4000, "hello world"]
    rows = [(i if i < 6 else 2, t, "", "") for i, t in enumerate(texts)] + [(None, "x", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    vocabulary = set(lm.pieces_of(lm.VOCABULARY))
    want = []
    for i, t, *_ in rows:
        words = (t or "").split()
        counts = [greedy("▁" + w, vocabulary) for w in words[:1] * len(words)] if len(set(words)) == 1 else [greedy("▁" + w, vocabulary) for w in words]
        want.append((-1 if i is None else i, len(words), sum(n for n, _ in counts), sum(b for _, b in counts)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_tokens, r.n_byte_tokens) for r in lm.count_tokens(df).collect()]
    assert sorted(got) == sorted(want)
    assert lm.count_tokens(df.limit(0)).count() == 0

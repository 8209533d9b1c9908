"""License scan: templates with optional and replaceable regions, compiled into automata over words.

A template is license wording with markup: what stands between <<beginOptional>> and <<endOptional>> may be missing, and
<<var;name=...;original=...;words=a-b>> stands for a to b words of any kind. It compiles into an automaton whose arcs are words or
"any word"; sets of its states are made deterministic as texts reach them and kept in a table. A text is
accepted from a place if its words lead to the end, so all mandatory wording stands there exactly.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lowered. ``score`` is the largest share of
a template's mandatory words that the words from some place matched in order: 1 if accepted, 0 if no template's first word occurs.
Null and empty texts have no words, no labels and score 0; repeated rows each give a row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tickloom.llm.common import map_texts

# Phrases and their labels, and public license wordings with markup for their variants.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "<<beginOptional>>This work is<<endOptional>> licensed under the Apache License, Version 2.0",
    "cc-by-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0 <<beginOptional>>International<<endOptional>>",
    "cc-by-nc-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0 <<beginOptional>>International<<endOptional>>",
    "copyright-notice": "Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=owner;original=year and owner;words=1-12>> All rights reserved",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "<<beginOptional>>This work is<<endOptional>> licensed under the GNU General Public License, version 3 <<beginOptional>>or <<beginOptional>>any<<endOptional>> later<<endOptional>>",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=work;original=this software;words=1-4>> and associated "
    "documentation files <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MARKUP = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class TemplateAutomaton:
    """States are numbers, 0 is the start and the last one the end. ``furthest(words, i)`` is the share of the mandatory words matched from place i, and where the longest accepted text ends."""

    def __init__(self, template: str):
        self.arcs: list[dict[bytes | None, set[int]]] = [{}]  # None: any word
        self.free: list[set[int]] = [set()]  # arcs that take no word
        self.end, open_at = 0, []
        for i, part in enumerate(_MARKUP.split(template)):
            if i % 2 == 0:
                for word in words_of(part):
                    self._step(word)
            elif part == "beginOptional":
                open_at.append(self._free_step(self.end))
            elif part == "endOptional":
                start = open_at.pop()
                self._free_step(self.end)
                self.free[start].add(self.end)
            else:
                least, most = map(int, dict(f.split("=") for f in part.split(";")[1:])["words"].split("-"))
                for _ in range(least):
                    self._step(None)
                first = self.end
                skipped = [first]
                for _ in range(most - least):
                    self._step(None)
                    skipped.append(self.end)
                self._free_step(self.end)
                for s in skipped:
                    self.free[s].add(self.end)
        if open_at:
            raise ValueError("an optional region is not closed")
        self.lacking = self._lacking()
        self.needed = self.lacking[0]
        if not self.needed:
            raise ValueError("a template needs mandatory words")
        self.start = self._closed({0})
        self.first_words = {w for s in self.start for w in self.arcs[s]}
        if None in self.first_words:
            raise ValueError("a template must start with a word")
        self.table: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        self.alphabet = {w for arcs in self.arcs for w in arcs if w is not None}

    def _new(self) -> int:
        self.arcs.append({})
        self.free.append(set())
        return len(self.arcs) - 1

    def _step(self, word: bytes | None) -> None:
        to = self._new()
        self.arcs[self.end].setdefault(word, set()).add(to)
        self.end = to

    def _free_step(self, at: int) -> int:
        to = self._new()
        self.free[at].add(to)
        self.end = to
        return to

    def _lacking(self) -> list[int]:
        """The fewest given words on a way to the end; arcs only lead to later states or over an optional region to its end."""
        out = [0] * len(self.arcs)
        for s in range(len(self.arcs) - 1, -1, -1):
            ways = [out[t] for t in self.free[s]] + [out[t] + (w is not None) for w, to in self.arcs[s].items() for t in to]
            out[s] = min(ways, default=0)
        return out

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()] - found:
                found.add(t)
                todo.append(t)
        return frozenset(found)

    def _next(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.alphabet else b"")
        if key not in self.table:
            self.table[key] = self._closed({t for s in states for t in self.arcs[s].get(key[1], set()) | self.arcs[s].get(None, set())})
        return self.table[key]

    def furthest(self, words: list[bytes], i: int) -> tuple[float, int | None]:
        states, best, accepted = self.start, self.needed, None
        while states:
            best = min(best, min(self.lacking[s] for s in states))
            if self.end in states:
                accepted = i
            if i == len(words):
                break
            states, i = self._next(states, words[i]), i + 1
        return 1 - best / self.needed, accepted


@lru_cache(4)
def _automata(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, TemplateAutomaton]]:
    return [(label, TemplateAutomaton(text)) for label, text in templates]


def scan_text(text: str, phrases: list[tuple[list[bytes], str]], automata: list[tuple[str, TemplateAutomaton]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, word after the last)."""
    body = text.encode().lower()
    inside = _IN_WORD[np.frombuffer(body, np.uint8)]
    n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(inside[:1].any())
    phrases = [p for p in phrases if all(w in body for w in p[0])]
    automata = [(label, a, starts) for label, a in automata if (starts := {w for w in a.first_words if w in body})]
    if not phrases and not automata:
        return n_words, 0, None, None, "", "", 0.0, []
    words = _WORD.findall(body)
    wanted = {p[0][0] for p in phrases} | {w for _, _, starts in automata for w in starts}
    places: dict[bytes, list[int]] = {w: [] for w in wanted}
    for i, w in enumerate(words):
        if w in wanted:
            places[w].append(i)
    found, base, labels, score, spans = [], set(), set(), 0.0, []
    for phrase, label in phrases:
        at = [i for i in places[phrase[0]] if words[i : i + len(phrase)] == phrase]
        found += at
        base |= {label} if at else set()
    for label, automaton, starts in automata:
        for i in sorted(i for w in starts for i in places[w]):
            share, end = automaton.furthest(words, i)
            score = max(score, share)
            if end is not None:
                labels.add(label)
                spans.append((label, i, end))
    return n_words, len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, spans


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """For each whole text: doc_id, n_words; n_base, first_word, last_word and base_labels of the phrases; labels of phrases and accepted templates; score; spans of accepted wording in words."""
    given, wanted = tuple(sorted(templates.items())), [(words_of(p), label) for p, label in sorted(phrases.items())]
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def make():
        automata = _automata(given)

        def work(cols):
            rows = [scan_text(t or "", wanted, automata) for t in cols["text"]]
            out = {name: [r[k] for r in rows] for k, name in enumerate(names)}
            out["spans"] = [[{"label": a, "first": b, "after": c} for a, b, c in s] for s in out["spans"]]
            return out | {"doc_id": cols["doc_id"]}

        return work

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, after: bigint>>"
    return map_texts(docs.select("doc_id", "text"), schema, make)

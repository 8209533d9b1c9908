"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts with one state that loops on all 256 bytes. Each merge (u, v) -> w in turn is a gadget: where
the state after u has an arc v, the path u v is replaced by an arc w, so the state after u is copied without v and
w leads where v led. All arcs of one token lead to one state. The states after u are thus a row of copies, each
with one arc less than the one before; the first is the state that the second part of u had when u was made. What a merge takes away
and when is all that is stored of them: whether a state has an arc follows, and is kept in a table of transitions once asked.

A text's pre-split words are encoded from left to right: the token that ends at a place is the one whose arc
leaves the state at its start. There is exactly one, since the automaton accepts just the right encodings.

The method needs merges whose parts were made by earlier merges (checked). Null texts are empty, an empty text has no
ids, special strings become their id wherever they stand, repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame

from tickloom.llm.common import WordCache, map_texts, remembers
from tickloom.llm.tokens import TextEncoder

VOCABULARY = path("byte_bpe_50k.json")

#: Transitions that a worker remembers before it starts anew.
ARCS = 600_000

#: Pieces of texts that a worker remembers, and words of such pieces (most pieces are one word), before it starts anew.
KNOWN_PIECES, KNOWN_WORDS = 250_000, 50_000


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level files write each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """Tokens are numbers; ``labels`` has each token's bytes, ``merges`` the triples (u, v, w) in order."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels = labels
        self.born = [-1] * n  # the merge that made a token; -1 for bytes
        self.left, self.right = [-1] * n, [-1] * n  # its parts
        self.taken: dict[int, int] = {}  # by state and arc: the merge that took the arc away
        made = {t for t in range(n) if len(labels[t]) == 1}
        for k, (u, v, w) in enumerate(merges):
            if u not in made or v not in made:
                raise ValueError("a merge uses a token that no earlier merge made")
            if self.has_arc(u, v):  # else the pair never stands in a text when its turn comes
                made.add(w)
                self.born[w], self.left[w], self.right[w] = k, u, v
                self.taken[u << 20 | v] = k
        self.search = ahocorasick.Automaton()
        for t in made:
            self.search.add_word(labels[t].decode("latin-1"), (t, len(labels[t]), t + 1))
        self.search.make_automaton()
        self.arcs = WordCache(lambda key: self.has_arc((key >> 20) - 1, key & 0xFFFFF), ARCS)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after the token ``state`` (-1: the start) has an arc ``token``.

        The arc came with the arc of the token's first part when the token was made, so that one must have been there
        then, and so on down to a byte, which every state has until it is taken away. A state lacks what was taken from it and what
        the state it was copied from lacked at that time.
        """
        until = 1 << 60
        while True:
            at, copied = state, 1 << 60
            while at >= 0:
                k = self.taken.get(at << 20 | token)
                if k is not None and k < copied and k <= until:
                    return False
                copied, at = self.born[at], self.right[at]
            if self.born[token] < 0:
                return True
            until, token = self.born[token], self.left[token]

    def encode(self, word: str) -> list[int]:
        """Tokens of a word given as one letter (latin-1) for each byte."""
        states, last = [0] * (len(word) + 1), [0] * (len(word) + 1)
        done, arcs = -1, self.arcs
        for end, (token, size, state) in self.search.iter(word):
            if end != done and arcs[states[end + 1 - size] << 20 | token]:
                states[end + 1], last[end + 1], done = state, token, end
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return out[::-1]


@lru_cache(2)
def load(vocabulary: str) -> tuple[MergeAutomaton, dict[str, int]]:
    """The automaton of a byte-level tokenizer file and its special strings; built once a process."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    letters, ids = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        labels[i] = bytes(letters[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    machine = MergeAutomaton(labels, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
    for token, i in special.items():
        labels[i] = token.encode()
    return machine, special


def text_encoder(vocabulary: str) -> TextEncoder:
    machine, special = load(vocabulary)
    split = regex.compile(PATTERN).findall
    known = WordCache(lambda word: np.array(machine.encode(word.encode().decode("latin-1")), "<u4").tobytes(), KNOWN_WORDS)
    return TextEncoder(lambda texts: [b"".join(map(known.__getitem__, split(t))) for t in texts], {s: np.array([i], "<u4").tobytes() for s, i in special.items()}, KNOWN_PIECES)


def decode(machine: MergeAutomaton, ids: bytes) -> str:
    return b"".join(map(machine.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _worker(vocabulary: str) -> tuple[TextEncoder, MergeAutomaton]:
    return text_encoder(vocabulary), load(vocabulary)[0]


def _forget() -> None:
    _worker.cache_clear()
    load.cache_clear()


remembers(__name__, _forget)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of each whole text, decoded from these ids."""

    def make():
        encoder, machine = _worker(vocabulary)

        def work(cols):
            ids = encoder.encode_all([t or "" for t in cols["text"]])
            return {"doc_id": cols["doc_id"], "ids": [np.frombuffer(b, "<u4").astype("i4") for b in ids], "decoded": [decode(machine, b) for b in ids]}

        return work

    return map_texts(docs.select("doc_id", "text"), "doc_id bigint, ids array<int>, decoded string", make)


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of UTF-8) of each whole text."""

    def make():
        encoder, machine = _worker(vocabulary)

        def work(cols):
            ids = encoder.encode_all([t or "" for t in cols["text"]])
            return {
                "doc_id": cols["doc_id"],
                "n_tokens": [len(b) // 4 for b in ids],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                "decoded_sha256": [hashlib.sha256(decode(machine, b).encode()).hexdigest() for b in ids],
            }

        return work

    return map_texts(docs.select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)

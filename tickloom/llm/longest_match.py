"""Token counts by greedy longest match in one pass over each word.

The vocabulary is a trie. Where a walk can go no further, a failure link leads to the node that remains after the longest
matching pieces are cut off the front, and a number stored with the link tells how many pieces that were. The
count grows by these numbers; no piece is ever built, and a word costs time in proportion to its length.

Words are runs of non-spaces, each with the mark of a word's start before it. A character that starts no piece costs one
token for each of its UTF-8 bytes. Null and empty texts have no words and no tokens; repeated rows each give a row.
"""

from __future__ import annotations

from functools import lru_cache

from public_tokenizers import path
from pyspark.sql import DataFrame

from tickloom.llm.common import WordCache, map_texts, remembers

VOCABULARY = path("piece_bpe_32k.model")
WORD_START = "▁"

#: A token made of one byte counts this much more, so that one sum carries both counts.
BYTE_TOKEN = 1 << 40


class LongestMatch:
    """``count(word)`` is the number of tokens, plus BYTE_TOKEN for each of them that is a byte."""

    def __init__(self, vocabulary: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = len(self.arcs)
                    self.arcs.append({})
                    whole.append(False)
                at = self.arcs[at][c]
            whole[at] = at > 0
        self.link, self.popped = [0] * len(self.arcs), [0] * len(self.arcs)
        level = [(0, c, node) for c, node in self.arcs[0].items()]
        while level:
            for parent, c, node in level:
                if whole[node]:
                    self.popped[node] = 1
                elif not parent:
                    self.popped[node] = self.bytes_of(c)
                else:
                    at, n = self.link[parent], self.popped[parent]
                    while c not in self.arcs[at] and at:
                        at, n = self.link[at], n + self.popped[at]
                    self.link[node], self.popped[node] = (self.arcs[at][c], n) if c in self.arcs[at] else (0, n + self.bytes_of(c))
            level = [(node, c, child) for _, _, node in level for c, child in self.arcs[node].items()]

    @staticmethod
    def bytes_of(c: str) -> int:
        return len(c.encode()) * (BYTE_TOKEN + 1)

    def count(self, word: str) -> int:
        arcs, link, popped, at, n = self.arcs, self.link, self.popped, 0, 0
        for c in word:
            while (to := arcs[at].get(c)) is None and at:
                n += popped[at]
                at = link[at]
            if to is None:
                n += self.bytes_of(c)
            else:
                at = to
        while at:
            n += popped[at]
            at = link[at]
        return n


def pieces_of(model: str) -> list[str]:
    """The pieces of a sentencepiece file without control and byte tokens."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


@lru_cache(2)
def _worker(model: str) -> WordCache:
    machine = LongestMatch(pieces_of(model))
    return WordCache(lambda word: machine.count(WORD_START + word))


remembers(__name__, _worker.cache_clear)


def count_tokens(docs: DataFrame, model: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_byte_tokens of each whole text."""

    def make():
        counts = _worker(model)

        def work(cols):
            words = [(t or "").split() for t in cols["text"]]
            sums = [sum(map(counts.__getitem__, w)) for w in words]
            return {"doc_id": cols["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [n % BYTE_TOKEN for n in sums], "n_byte_tokens": [n // BYTE_TOKEN for n in sums]}

        return work

    return map_texts(docs.select("doc_id", "text"), "doc_id bigint, n_words bigint, n_tokens bigint, n_byte_tokens bigint", make)

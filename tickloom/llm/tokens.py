"""Whole texts to token ids with a public byte-level BPE file, remembering what equal words gave.

A text is cut before each space that stands before a non-space: the pre-split pattern always cuts there, so
the pieces encode alone as they do in the text. Each piece is encoded once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tickloom.llm.common import CACHE_WORDS

#: Marks that often end a word.
MARKS = ".,;:!?"

_CUT = re.compile(r" (?=\S)")


class TextEncoder:
    """``encode(text)`` gives the ids of a text as little-endian unsigned 32-bit bytes.

    ``encode_pieces`` turns a list of texts into a list of such bytes. ``special`` maps the strings that
    become one id wherever they stand to that id's bytes.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], special: dict[str, bytes], most: int = CACHE_WORDS):
        self.encode_pieces, self.special, self.most = encode_pieces, special, most
        self.known: dict[str, bytes] = {}  # pieces, after a space
        self.heads: dict[str, bytes] = {}  # first pieces of texts
        self.marks = dict(zip(MARKS, encode_pieces(list(MARKS)), strict=True))
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def learn(self, pieces: set[str]) -> set[str]:
        """Encode the pieces not known yet in one go; returns those that are empty or start with a space, which are no pieces."""
        new = pieces.difference(self.known)
        odd = {p for p in new if not p or p[0].isspace()}
        ended = {p for p in new if p[-1:] in self.marks and p[-2:-1].isalpha()}  # the pattern always cuts after a letter that a mark follows
        whole = list((new - odd - ended).union({p[:-1] for p in ended}.difference(self.known)))
        self.known.update(zip(whole, self.encode_pieces([" " + p for p in whole]), strict=True))
        self.known.update({p: self.known[p[:-1]] + self.marks[p[-1]] for p in ended})
        return odd

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [[p for p in self.at_special.split(t) if p] if self.at_special and self.at_special.search(t) else [t] for t in texts]
        plain = [p for parts in cut for p in parts if p not in self.special]
        pieces = [p.split(" ") for p in plain]
        heads = [p.pop(0) for p in pieces]
        if len(self.known) + len(self.heads) > self.most:  # only what these texts use again stays
            self.known = {p: self.known[p] for p in set().union(*pieces).intersection(self.known)}
            self.heads.clear()
        if odd := self.learn(set().union(*pieces)):
            for i, p in enumerate(pieces):
                if not odd.isdisjoint(p):
                    heads[i], *pieces[i] = _CUT.split(plain[i])
                    self.learn(set(pieces[i]))
        new = list({h for h in heads if h and h not in self.heads})
        self.heads.update(zip(new, self.encode_pieces(new), strict=True), **{"": b""})
        at, done = self.known.__getitem__, iter(zip(heads, pieces, strict=True))
        return [b"".join(self.special[p] if p in self.special else self.heads[(h := next(done))[0]] + b"".join(map(at, h[1])) for p in parts) for parts in cut]

"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised from left to right: at each place the longest prefix that the compiled character map knows is
replaced (a single character stays where none is known), and every byte written records the source byte its prefix
started at. The normalised text is merged to pieces by score; what no piece covers becomes byte pieces. Each piece then takes
the source bytes from its first byte's record to the next piece's, so all pieces together cover the text.

The map is a double array of 32-bit units, followed by the replacements as NUL-ended strings. A file whose map is empty
normalises each character to itself. A merge never joins two neighbours that stand together in no piece of the vocabulary, so a text is cut
before space marks, between a letter and a mark and around line ends where the vocabulary shows this to be right, and what a cut-out run gives is remembered.

Null texts are empty, an empty text has no ids, repeated rows each give a row, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from public_tokenizers import path
from pyspark.sql import DataFrame

from tickloom.llm.common import WordCache, map_texts, remembers

VOCABULARY = path("piece_bpe_32k.model")

#: Fixed values of the file format: the space mark, the kinds of pieces, the replacement of bytes that are no character.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REPLACEMENT = "�"

#: A longer run is encoded but not remembered, and its pairs wait in a heap.
LONG_RUN = 40

#: Marks before which a text may be cut after a letter.
MARKS, LETTER = ".,;:!?", re.compile(r"[^\W\d_]")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map; ``prefix(data, i)`` gives (replacement or None, bytes consumed)."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        # What a first byte cannot start is passed over without a walk.
        self.starts = {b for b in range(256) if self.units and self._step(self._child(0), b) is not None}

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def prefix(self, data: bytes, i: int) -> tuple[bytes | None, int]:
        if data[i] not in self.starts:
            return None, 0
        best, base, at = None, self._child(0), i
        while at < len(data) and (node := self._step(base, data[at])) is not None:
            base, at = self._child(node), at + 1
            if self.units[node] & 0x100:
                best = (self.units[base] & 0x7FFFFFFF, at - i)
        if best is None:
            return None, 0
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]


class PieceModel:
    """A vocabulary file: pieces with scores and kinds, the character map and the rules for spaces."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        normal, trainer = {}, {}
        for number, value in wire_fields(data):
            if number == 1:
                fields = dict(wire_fields(value))
                self.pieces.append(fields[1].decode())
                self.scores.append(struct.unpack("<f", fields.get(2, bytes(4)))[0])
                self.kinds.append(fields.get(3, NORMAL))
            elif number == 2:
                trainer = dict(wire_fields(value))
            elif number == 3:
                normal = dict(wire_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only vocabularies of merged pieces are read")
        self.map = CharacterMap(normal.get(2, b""))
        self.dummy, self.tidy, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        self.suffix, self.fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        merged = (NORMAL, USER_DEFINED, UNUSED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in merged}
        self.reserved = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k not in merged}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [self.reserved.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if i != self.unknown}
        own = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.own = frozenset(own)
        self.at_own = re.compile("|".join(map(re.escape, own))) if own else None
        self.cut = self._cuts(bool(own))
        self.surfaces = [p.replace(SPACE, " ") for p in self.pieces]
        self.widths = [len(s.encode()) for s in self.surfaces]
        #: Place of each piece by score, equal scores sharing one; empty where pieces may come apart again or stand together by rule.
        places = {v: i for i, v in enumerate(sorted({-self.scores[i] for i in self.ids.values()}))}
        self.order = {} if own or UNUSED in self.kinds else {p: places[-self.scores[i]] for p, i in self.ids.items()}
        #: Every byte becomes itself or a space mark, and only one mark is added in front.
        self.plain = not self.map.units and not self.tidy and self.escape and self.dummy and not self.suffix and not own

    def _cuts(self, whole: bool) -> re.Pattern:
        """Matches the runs that merge alone: no piece holds the two characters on either side of a cut."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if whole or self.suffix or any(b == SPACE != a for a, b in pairs):
            return re.compile(".+", re.S)
        alone = "".join(c for c in "\n\t" if not any(c in p for p in pairs))
        rest, joined = f"[^{SPACE}{alone}{MARKS}]", "".join({p[0] for p in pairs if p[1] in MARKS and LETTER.match(p)})
        more = f"(?:(?<![^\\W\\d_{joined}])[{MARKS}]+{rest}*)*"  # a mark goes on unless a letter that no piece joins to a mark is before it
        parts = [f"{SPACE}+{rest}*{more}", f"{rest}+{more}", f"[{MARKS}]+{rest}*{more}"]
        return re.compile("|".join([*parts, *([f"[{alone}]"] if alone else [])]))

    # --- normalisation -------------------------------------------------------------------------
    def _prefix(self, data: bytes, text: str, at: dict[int, int], i: int) -> tuple[bytes, int]:
        if self.at_own and (m := self.at_own.match(text, at[i])):
            own = m.group().encode()
            return own, len(own)
        found, used = self.map.prefix(data, i)
        if found is None:
            used = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            found = data[i : i + used]
        return found, used

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes and, for each of them and for the end, the source byte it came from."""
        data, space = text.encode(), SPACE.encode() if self.escape else b" "
        at = {b: c for c, b in enumerate(accumulate((len(c.encode()) for c in text), initial=0))} if self.at_own else {}
        out, origin, i = bytearray(), [], 0
        if self.tidy:
            while i < len(data) and (found := self._prefix(data, text, at, i))[0] == b" ":
                i += found[1]
        if i == len(data):
            return b"", [0]

        def write(part: bytes) -> None:
            out.extend(part)
            origin.extend([i] * len(part))

        if self.dummy and not self.suffix:
            write(space)
        after_space = self.tidy
        while i < len(data):
            part, used = self._prefix(data, text, at, i)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                write(part.replace(b" ", space))
                after_space = self.tidy and part.endswith(b" ")
            i += used
        if self.tidy:
            while out.endswith(space):
                i = origin[len(out) - len(space)]
                del out[-len(space) :], origin[-len(space) :]
        if self.dummy and self.suffix:
            write(space)
        return bytes(out), [*origin, i]

    # --- pieces --------------------------------------------------------------------------------
    def merge_short(self, run: str) -> list[str]:
        """``merge`` for a short run: the list of pairs is looked through for each merge."""
        parts, none = list(run), len(self.pieces)
        ranks = [self.order.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.order.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = self.order.get(parts[i] + parts[i + 1], none)
        return parts

    def merge(self, run: str) -> list[str]:
        """Merge neighbours that form a piece, the best score first and the leftmost among equals."""
        if len(run) <= LONG_RUN and self.order:
            return self.merge_short(run)
        parts: list[str | None] = []
        if self.at_own:
            last = 0
            for m in self.at_own.finditer(run):
                parts += [*run[last : m.start()], m.group()]
                last = m.end()
            parts += run[last:]
        else:
            parts = list(run)
        frozen = [p in self.own for p in parts]
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        halves: dict[str, tuple[str, str]] = {}
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or frozen[a] or frozen[b]:
                return
            both = parts[a] + parts[b]
            if (k := self.ids.get(both)) is not None:
                heapq.heappush(heap, (-self.scores[k], a, b, len(both)))
                if self.kinds[k] == UNUSED:
                    halves[both] = parts[a], parts[b]

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b], after[a] = None, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out, todo = [], [p for p in reversed(parts) if p is not None]
        while todo:  # pieces out of use fall back to the two parts they were merged from
            p = todo.pop()
            if p in halves and self.kinds[self.ids[p]] == UNUSED:
                todo += reversed(halves[p])
            else:
                out.append(p)
        return out

    def encode_run(self, run: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a normalised run, and where in its bytes each piece starts and ends; of byte pieces the last holds the character."""
        ids, starts, ends, at = [], [], [], 0
        for p in self.merge(run):
            raw = p.encode()
            i = self.reserved.get(p, self.ids.get(p))
            if i is None and self.fallback:
                ids += [self.bytes[b] for b in raw]
                starts += [at] * len(raw)
                ends += [at] * (len(raw) - 1) + [at + len(raw)]
            else:
                ids.append(self.unknown if i is None else i)
                starts.append(at)
                ends.append(at + len(raw))
            at += len(raw)
        return ids, starts, ends

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a text, and the source bytes from (included) and to (left out) of each piece."""
        data, origin = self.normalise(text)
        ids, starts, ends, at = [], [], [], 0
        for run in self.cut.findall(data.decode()):
            more, a, b = self.encode_run(run)
            ids += more
            starts += [origin[at + x] for x in a]
            ends += [origin[at + x] for x in b]
            at += len(run.encode())
        if not self.fallback:  # neighbours that are unknown become one piece
            for k in range(len(ids) - 1, 0, -1):
                if ids[k] == ids[k - 1] == self.unknown:
                    ends[k - 1] = ends[k]
                    del ids[k], starts[k], ends[k]
        return ids, starts, ends

    def decode(self, ids: list[int]) -> str:
        """Pieces in a row with space marks as spaces; the marks added in front go, control pieces give nothing."""
        out, held, fresh = [], bytearray(), True

        def flush() -> None:
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + REPLACEMENT)
                    del held[: e.start + 1]

        for i in ids:
            if self.kinds[i] == BYTE:
                held.append(self.byte_of[i])
                fresh = False
                continue
            flush()
            kind, piece = self.kinds[i], self.pieces[i]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                piece = self.unknown_text
            elif fresh and (self.dummy or self.tidy):
                if self.tidy:
                    piece = piece.lstrip(SPACE)
                    if not piece:
                        continue
                else:
                    piece = piece.removeprefix(SPACE)
            out.append(piece if kind == UNKNOWN else piece.replace(SPACE, " "))
            fresh = False
        flush()
        return "".join(out)


@lru_cache(maxsize=1)
def load(vocabulary: str) -> PieceModel:
    with open(vocabulary, "rb") as f:
        return PieceModel(f.read())


class RunCache(WordCache):
    def __missing__(self, key):
        return self.make(key) if len(key) > LONG_RUN else super().__missing__(key)


class PlainRuns:
    """Runs of a file without a map, as (ids in decimal, decoded text, source bytes between piece ends).

    There a run's source is the run itself with spaces for marks, so its spans do not depend on what stands before it.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.known = RunCache(self._make)

    def _make(self, run: str) -> tuple[str, str, bytes]:
        model = self.model
        try:
            ids = [model.ids[p] for p in model.merge(run)]
            steps, decoded = [model.widths[i] for i in ids], "".join([model.surfaces[i] for i in ids])
        except KeyError:  # bytes stand for a character that no piece covers
            ids, _, ends = model.encode_run(run)
            data, last, steps = run.encode(), 0, []
            for e in ends:
                steps.append(max(e - last, 0) - 2 * data[last:e].count(SPACE.encode()))
                last = max(last, e)
            decoded = model.decode([model.bytes[0], *ids])[1:]  # in the middle of a text, so no mark is taken off
        return ",".join(map(str, ids)), decoded, struct.pack(f"<{len(steps)}I", *steps)

    def digest(self, text: str) -> tuple[str, str, bytes]:
        """Ids joined by commas, decoded text and piece ends as little-endian 32-bit numbers of a whole text."""
        if not text:
            return "", "", b""
        found = list(map(self.known.__getitem__, self.model.cut.findall(SPACE + text.replace(" ", SPACE))))
        ids, decoded, steps = zip(*found, strict=True)
        ends = np.cumsum(np.frombuffer(b"".join(steps), "<u4"), dtype="<u4") - np.uint32(1)  # the mark in front is no source
        return ",".join(ids), "".join(decoded)[1:], ends.tobytes()


@lru_cache(maxsize=1)
def plain_runs(vocabulary: str) -> PlainRuns:
    return PlainRuns(load(vocabulary))


def _forget() -> None:
    plain_runs.cache_clear()
    load.cache_clear()


remembers(__name__, _forget)


def digest(model: PieceModel, runs: PlainRuns, text: str) -> tuple[str, str, bytes]:
    if model.plain and SPACE not in text:
        return runs.digest(text)
    ids, _, ends = model.encode(text)
    return ",".join(map(str, ids)), model.decode(ids), np.array(ends, "<u4").tobytes()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, starts, ends (source bytes of each piece) and decoded text of each whole text."""

    def make():
        model = load(vocabulary)

        def work(cols):
            found = [model.encode(t or "") for t in cols["text"]]
            ids, starts, ends = zip(*found, strict=True) if found else ((), (), ())
            return {"doc_id": cols["doc_id"], "ids": ids, "starts": starts, "ends": ends, "decoded": [model.decode(i) for i in ids]}

        return work

    return map_texts(docs.select("doc_id", "text"), "doc_id bigint, ids array<int>, starts array<int>, ends array<int>, decoded string", make)


def piece_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8), source_bytes (that the pieces cover)
    and ends_crc32 (of the pieces' source ends as little-endian unsigned 32-bit numbers) of each whole text.
    """

    def make():
        model, runs = load(vocabulary), plain_runs(vocabulary)

        def work(cols):
            out = {n: [] for n in ("n_tokens", "ids_sha256", "decoded_sha256", "source_bytes", "ends_crc32")}
            for text in cols["text"]:
                ids, decoded, ends = digest(model, runs, text or "")
                out["n_tokens"].append(len(ends) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["source_bytes"].append(int.from_bytes(ends[-4:], "little"))
                out["ends_crc32"].append(zlib.crc32(ends))
            return {"doc_id": cols["doc_id"], **out}

        return work

    return map_texts(docs.select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, source_bytes bigint, ends_crc32 bigint", make)

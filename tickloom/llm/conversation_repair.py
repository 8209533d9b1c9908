"""Repair of damaged conversations by the cheapest edits that give the order of roles ``(s?(ua)+)?``.

A conversation's rows (by turn, rows without one first, then role and text) and the places in the order of roles span a lattice: node (i, q) has read i rows
and written an order that leads to place q. Keeping, reroling or deleting a row leads to i + 1, inserting stays at i. Dijkstra's search runs
from both ends with a heap each; a forward label is cost and edits so far, a backward one cost and edits to come, so of equally cheap labels a node keeps the least. The
searches stop once what is left in both heaps cannot make a path as cheap as the best one found, so every crossing of equal cost is there, and the least of the
concatenated audits is taken. No label of a node is the start of another of the same cost, so least parts make least wholes.

Rows are sorted by ranges. A conversation that lies within a range and the limits of memory is repaired where it is read. The others (those at
the edges of ranges, and long ones however many ranges they fill) are cut into blocks: a block is searched from each place to each other, a stream over the blocks of a conversation
adds these up to the cheapest whole, and a second stream hashes the repaired blocks in order. Both ways give the same rows.

Null roles and texts are one space, and so are null ids and turns where the damage is drawn; no id is a conversation of its own. A role without characters is no role
that can stand. Repeated rows are repeated turns, an empty table gives no rows, extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.llm.common import enter, stored

SPACES, STOPS = " \t\n\v\f\r", ".!?"

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

#: Places in the order of roles: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

#: Rows and bytes of a conversation that are held in memory, and rows of a block.
HELD_ROWS, HELD_BYTES, BLOCK = 2048, 8 << 20, 512

RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
COUNTS = ("blank", "duplicate", "truncated")


# --- the lattice -----------------------------------------------------------------------------------
def due(place: int) -> str:
    """The role that an insertion or a new role must have."""
    return "a" if place == USER else "u"


def step(place: int, initial: str) -> int | None:
    """The place after a role's initial, None where it may not stand."""
    if initial == "s":
        return SYSTEM if place == START else None
    return {"u": USER, "a": ASSISTANT}[initial] if initial == due(place) else None


def _turned(moves: Sequence[Sequence[tuple[int, int, str]]]) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    return tuple(tuple((p, cost, letter) for p in PLACES for q, cost, letter in moves[p] if q == place) for place in PLACES)


@lru_cache
def moves(initial: str, fault: str):
    """Moves (other place, cost, letter) over a row by the place before it, and by the place after it."""
    extra = CUT_OFF if fault == "truncated" else 0
    out = []
    for p in PLACES:
        own = [(p, DELETE, "D")]
        if fault not in ("blank", "duplicate"):
            own.append((step(p, due(p)), REROLE + extra, "R"))
            if initial in ("s", "u", "a") and (q := step(p, initial)) is not None:
                own.append((q, extra, "K"))
        out.append(tuple(own))
    return tuple(out), _turned(out)


INSERTS = tuple(((step(p, due(p)), INSERT, "I"),) for p in PLACES)
INSERTS_BACK = _turned(INSERTS)


def cheapest(rows: Sequence[tuple[str, str]], first: Sequence[int] = (START,), last: Sequence[int] = ENDS) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits of rows (initial, fault) from a place in ``first`` to one in ``last``."""
    n, table = len(rows), [moves(*r) for r in rows]
    ahead: list = [(0, 0, "", p) for p in first]
    behind: list = [(0, -n, "", p) for p in last]
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    remaining: dict[tuple[int, int], tuple[int, str]] = {}
    best = float("inf")
    while ahead and behind and ahead[0][0] + behind[0][0] <= best:
        if ahead[0][0] <= behind[0][0]:
            cost, i, audit, p = heappop(ahead)
            if (i, p) in reached:
                continue
            reached[i, p] = cost, audit
            if (i, p) in remaining:
                best = min(best, cost + remaining[i, p][0])
            edges = [(i, e) for e in INSERTS[p]] + ([(i + 1, e) for e in table[i][0][p]] if i < n else [])
            for j, (q, more, letter) in edges:
                if (j, q) in remaining:
                    best = min(best, cost + more + remaining[j, q][0])
                if (j, q) not in reached:
                    heappush(ahead, (cost + more, j, audit + letter, q))
        else:
            cost, back, audit, q = heappop(behind)
            i = -back
            if (i, q) in remaining:
                continue
            remaining[i, q] = cost, audit
            if (i, q) in reached:
                best = min(best, cost + reached[i, q][0])
            edges = [(i, e) for e in INSERTS_BACK[q]] + ([(i - 1, e) for e in table[i - 1][1][q]] if i else [])
            for j, (p, more, letter) in edges:
                if (j, p) in reached:
                    best = min(best, cost + more + reached[j, p][0])
                if (j, p) not in remaining:
                    heappush(behind, (cost + more, -j, letter + audit, p))
    found = []
    for (i, p), (cost, audit) in reached.items():
        if (i, p) in remaining and cost + remaining[i, p][0] == best:
            found.append(audit + remaining[i, p][1])
        for j, (q, more, letter) in [(i, e) for e in INSERTS[p]] + ([(i + 1, e) for e in table[i][0][p]] if i < n else []):
            if (j, q) in remaining and cost + more + remaining[j, q][0] == best:
                found.append(audit + letter + remaining[j, q][1])
    return (int(best), min(found)) if found else None


def apply(rows: Sequence[tuple[str, str]], audit: str, place: int = START) -> tuple[list[str], int]:
    """The repaired ``role:text`` lines of rows (role, text), and the place after them."""
    out, left = [], iter(rows)
    for letter in audit:
        if letter == "I":
            initial, role, text = due(place), ROLES[due(place)], ""
        else:
            role, text = next(left)
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else due(place)
            role = role if letter == "K" else ROLES[initial]
        out.append(f"{role}:{text}")
        place = step(place, initial)
    return out, place


def fault_of(text: str) -> str:
    """blank, truncated or nothing."""
    text = text.rstrip(SPACES)
    return "blank" if not text else "" if text[-1] in STOPS else "truncated"


def gaps_of(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def illegal_in(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repair(rows: Sequence[tuple[int | None, str, str]]) -> dict:
    """All result columns of a whole conversation of rows (turn, role, text) in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        fault = fault_of(text)
        marked.append((role[:1], fault if fault == "blank" else "duplicate" if (role, text) in seen else fault))
        seen.add((role, text))
    cost, audit = cheapest(marked)
    turns = {t for t, _, _ in rows if t is not None}
    faults = [f for _, f in marked]
    lines, _ = apply([r[1:] for r in rows], audit)
    return {
        "gaps": gaps_of(min(turns, default=None), max(turns, default=None), len(turns)), **{c: faults.count(c) for c in COUNTS},
        "illegal": illegal_in([i for i, _ in marked]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


# --- the table -------------------------------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of each row after the damage that the crc32 of ``conv_id:turn`` draws."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.withColumn("_d", F.crc32(key.cast("binary")) % 20)
    role, text, drawn = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("_d")
    return rows.select(
        "conv_id",
        "turn",
        F.when(drawn == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(drawn <= 1, F.lit("")).when(drawn == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).alias("copies"),
    )


HEAD = "conv_id bigint, done boolean, "
OPEN = "part int, row bigint, turn bigint, role string, text string, fault string, mark string"
PASS = f"{HEAD}{RESULT}, repaired_sha256 string, {OPEN}"


def first_pass(damaged: DataFrame) -> DataFrame:
    """Results (done) of the conversations that a range holds whole, and the rows of the others with their range and place.

    ``mark`` names role and text of an open row; it is empty where an earlier row of the range has the same.
    """
    by = ["conv_id", "turn", "role", "text"]
    head = [*by[:3], F.substring("text", 1, 16)]
    arrow = to_arrow_schema(T.StructType.fromDDL(PASS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        part, number, ready = TaskContext.get().partitionId(), 0, []
        rows: list = []
        size, held, seen, is_open, current, begun = 0, 0, set(), True, None, False

        def release() -> None:
            """Hand the held rows over as open ones."""
            nonlocal rows, size, number, held
            for turn, role, text in rows:
                fault, mark = fault_of(text), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
                ready.append({"conv_id": current, "done": False, "part": part, "row": number, "turn": turn, "role": role, "text": text, "fault": fault, "mark": "" if mark in seen else mark})
                seen.add(mark)
                number += 1
                held += len(text)
            if not rows and not seen:  # all rows were dropped: the conversation still has a result
                ready.append({"conv_id": current, "done": False, "part": part, "row": number, "fault": "dropped"})
                number += 1
            rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            nonlocal ready, held
            out, ready, held = pa.RecordBatch.from_pylist(ready, schema=arrow), [], 0
            return out

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != current:
                    if begun:
                        if is_open:
                            release()
                            is_open = False
                        else:
                            ready.append({"conv_id": current, "done": True, **repair(rows)})
                            rows, size = [], 0
                        seen = set()
                    current, begun = conv, True
                rows += [(turn, role, text)] * copies
                size += len(text) * copies
                if len(rows) > HELD_ROWS or size > HELD_BYTES:
                    is_open = True
                    release()
                if len(ready) >= HELD_ROWS or held > HELD_BYTES:
                    yield batch_of()
        if begun:
            release()
        if ready:
            yield batch_of()

    ordered = damaged.repartitionByRange(*head).sortWithinPartitions(*by)
    return ordered.select(*by, "copies").mapInArrow(run, PASS)


def _stream(rows: DataFrame, out: str, order: Sequence[str], begin, add, end) -> DataFrame:
    """Read each conversation's rows in order in one pass: ``begin()`` gives a state, ``add(state, row)`` takes a row in, ``end(conv, state)`` gives output rows."""
    arrow = to_arrow_schema(T.StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        current, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if state is not None and row["conv"] != current:
                    yield pa.RecordBatch.from_pylist(end(current, state), schema=arrow)
                    state = None
                if state is None:
                    current, state = row["conv"], begin()
                add(state, row)
        if state is not None:
            yield pa.RecordBatch.from_pylist(end(current, state), schema=arrow)

    return rows.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, out)


EDGES = [f"c{p}{q}" for p in PLACES for q in PLACES]
BLOCKS = "conv string, part int, block bigint, dropped boolean, low bigint, high bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, " + ", ".join(f"{e} struct<cost: bigint, audit: string>" for e in EDGES)


def block_summaries(rows: DataFrame) -> DataFrame:
    """Counts of each block of open rows, and cost and audit from each place before it to each place after it."""
    arrow = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def run(key, table):
        enter(__name__)
        conv, part, block = (k.as_py() for k in key)
        rows = table.sort_by("row").to_pylist()
        kept = [r for r in rows if r["fault"] != "dropped"]
        turns = {r["turn"] for r in kept if r["turn"] is not None}
        marked = [(r["role"][:1], r["fault"]) for r in kept]
        out = {"conv": conv, "part": part, "block": block, "dropped": not kept, "low": min(turns, default=None), "high": max(turns, default=None), "distinct": len(turns)}
        out |= {c: sum(f == c for _, f in marked) for c in COUNTS} | {"illegal": illegal_in([i for i, _ in marked])}
        out |= {"head": marked[0][0], "tail": marked[-1][0]} if kept else {}
        for p in PLACES:
            for q in PLACES:
                if found := cheapest(marked, (p,), (q,)):
                    out[f"c{p}{q}"] = {"cost": found[0], "audit": found[1]}
        return pa.Table.from_pylist([out], schema=arrow)

    return rows.groupBy("conv", "part", "block").applyInArrow(run, BLOCKS)


CHOSEN = f"conv string, part int, block bigint, place int, piece string, {RESULT}"


def choose(blocks: DataFrame) -> DataFrame:
    """A row with the result of each conversation (no part), and one with each block's share of the audit and the place before it."""

    def begin() -> dict:
        return {"labels": {START: (0, "", None)}, "low": None, "high": None, "distinct": 0, "tail": None, "illegal": 0, "keys": [], **dict.fromkeys(COUNTS, 0)}

    def add(state: dict, row: dict) -> None:
        if row["dropped"]:
            return
        labels: dict = {}
        for p, (cost, audit, chain) in state["labels"].items():
            for q in PLACES:
                if edge := row[f"c{p}{q}"]:
                    label = (cost + edge["cost"], audit + edge["audit"])
                    if q not in labels or label < labels[q][:2]:
                        labels[q] = (*label, (chain, p, edge["audit"]))
        state["labels"] = labels
        state["keys"].append((row["part"], row["block"]))
        for c in COUNTS:
            state[c] += row[c]
        state["illegal"] += row["illegal"] + (state["tail"] is not None and state["tail"] + row["head"] not in LEGAL)
        if row["low"] is not None:  # turns ascend, so only neighbouring blocks can share one
            state["distinct"] += row["distinct"] - (state["high"] == row["low"])
            state["low"], state["high"] = row["low"] if state["low"] is None else state["low"], row["high"]
        state["tail"] = row["tail"]

    def end(conv: str, state: dict) -> list[dict]:
        cost, audit, chain = min((v for q, v in state["labels"].items() if q in ENDS), key=lambda v: v[:2])
        out = [{"conv": conv, "gaps": gaps_of(state["low"], state["high"], state["distinct"]), **{c: state[c] for c in (*COUNTS, "illegal")}, "cost": cost, "audit": audit}]
        for part, block in reversed(state["keys"]):
            chain, place, piece = chain
            out.append({"conv": conv, "part": part, "block": block, "place": place, "piece": piece})
        return out

    return _stream(blocks, CHOSEN, ["part", "block"], begin, add, end)


def repaired_blocks(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired lines of each block, as one text; nothing for blocks of which no line is left."""

    def run(left, right):
        enter(__name__)
        out = {"conv": [], "part": [], "block": [], "lines": []}
        for share in right.to_pylist():
            lines, _ = apply([(r["role"], r["text"]) for r in left.sort_by("row").to_pylist()], share["piece"], share["place"])
            if lines:
                out["conv"].append(share["conv"])
                out["part"].append(share["part"])
                out["block"].append(share["block"])
                out["lines"].append("\n".join(lines))
        return pa.table([pa.array(out["conv"], "string"), pa.array(out["part"], "int32"), pa.array(out["block"], "int64"), pa.array(out["lines"], "string")], names=list(out))

    keys = ["conv", "part", "block"]
    shares = chosen.filter("part IS NOT NULL").select(*keys, "place", "piece")
    return rows.filter("fault <> 'dropped'").groupBy(*keys).cogroup(shares.groupBy(*keys)).applyInArrow(run, "conv string, part int, block bigint, lines string")


def hashes(blocks: DataFrame) -> DataFrame:
    """sha256 of the lines of all blocks of a conversation."""

    def add(state: list, row: dict) -> None:
        state[0].update((("\n" if state[1] else "") + row["lines"]).encode())
        state[1] = True

    return _stream(blocks, "conv string, repaired_sha256 string", ["part", "block"], lambda: [hashlib.sha256(), False], add, lambda conv, state: [{"conv": conv, "repaired_sha256": state[0].hexdigest()}])


def repair_open(rows: DataFrame) -> DataFrame:
    """Results of the conversations whose rows are given one by one."""
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    at = F.struct("part", "row")
    firsts = rows.filter("mark <> ''").groupBy("conv", "mark").agg(F.min(at).alias("_first"))
    again = F.when(F.col("fault").isin("dropped", "blank"), F.col("fault")).when((F.col("mark") == "") | (F.col("_first") < at), "duplicate").otherwise(F.col("fault"))
    marked = stored(rows.join(firsts, ["conv", "mark"], "left").select("conv", "part", "row", F.expr(f"row div {BLOCK}").alias("block"), "turn", "role", "text", again.alias("fault")))
    chosen = stored(choose(block_summaries(marked)))
    digests = hashes(repaired_blocks(marked, chosen))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    whole = chosen.filter("part IS NULL").join(digests, "conv", "left")
    return whole.select(F.expr("nullif(conv, '-')").cast("bigint").alias("conv_id"), *names, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation after the damage."""
    rows = stored(first_pass(damage(conversations)))
    done = rows.filter("done").select("conv_id", *[f.split(" ")[0] for f in RESULT.split(", ")], "repaired_sha256")
    return done.unionByName(repair_open(rows.filter("NOT done").select("conv_id", *[f.split(" ")[0] for f in OPEN.split(", ")])))

import hashlib
import itertools
import random
import zlib

import pytest

from tickloom.llm import conversation_repair as repair

SCHEMA = "turn bigint, conv_id bigint, text string, role string, audit string, part int"


def machine(place, initial):
    """The order of roles, written out."""
    return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((place, initial))


def plain(rows, first=("0",), last=("0", "a")):
    """Least (cost, edits) by going over the rows once, each place holding its least label."""
    labels = {p: (0, "") for p in first}

    def offer(table, q, cost, audit):
        if q is not None and (q not in table or (cost, audit) < table[q]):
            table[q] = cost, audit

    def insertions(table):
        for _ in range(4):
            for p, (cost, audit) in list(table.items()):
                for w in "ua":
                    offer(table, machine(p, w), cost + 5, audit + "I")
        return table

    labels = insertions(labels)
    for initial, fault in rows:
        new, extra = {}, 5 if fault == "truncated" else 0
        for p, (cost, audit) in labels.items():
            offer(new, p, cost + 2, audit + "D")
            if fault not in ("blank", "duplicate"):
                if initial in "sua" and initial:
                    offer(new, machine(p, initial), cost + extra, audit + "K")
                for w in "ua":
                    offer(new, machine(p, w), cost + 1 + extra, audit + "R")
        labels = insertions(new)
    found = [labels[p] for p in last if p in labels]
    return min(found) if found else None


def test_both_heaps_meet_at_the_least_audit():
    rng = random.Random(4)
    kinds = [(w, f) for w in ("s", "u", "a", "t", "") for f in ("", "truncated", "duplicate", "blank")]
    for n in range(4):
        for rows in itertools.islice(itertools.product(kinds, repeat=n), 0, None, 1 if n < 3 else 7):
            assert repair.cheapest(rows) == plain(rows), rows
    names = "0sua"
    for _ in range(300):
        rows = [rng.choice(kinds[:9]) for _ in range(rng.randint(0, 30))]
        assert repair.cheapest(rows) == plain(rows), rows
        for p, q in itertools.product(repair.PLACES, repair.PLACES):
            assert repair.cheapest(rows, (p,), (q,)) == plain(rows, (names[p],), (names[q],)), (rows, p, q)


def brute(rows):
    groups = {}
    for turn, conv, text, role, *_ in rows:
        own = groups.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if drawn:
            text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(drawn, text)
            own += [(turn, "user" if drawn == 4 else role, text)] * (2 if drawn == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain([(r[1][:1], f) for r, f in zip(own, faults)])
        lines, place, left = [], "0", iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(left)[1:]
            if letter != "D":
                role = role if letter == "K" else "assistant" if place == "u" else "user"
                place = machine(place, role[0])
                lines.append(f"{role}:{text}")
        turns = {r[0] for r in own} - {None}
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, conversations, hot=0):
    rng = random.Random(seed)
    texts = ["Hi.", "Why?", "", "  \n", "no end", "Ünd so!  ", None, "x" * 30 + ".", "a\tb.", "What now"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in [*range(conversations), None]:
        for i in range(rng.randint(1, 9)):
            rows.append((rng.choice([i, i, i, i + 1, None, -i]), conv, rng.choice(texts), rng.choice(roles[:2] if rng.random() < 0.7 else roles), "z", 1))
    rows += [(i // 2, 7777, f"{texts[i * i % 10] or ''}{i % 40 if i % 3 else ''}.", roles[i % 2 if i % 7 else i % 8], "z", 1) for i in range(hot)]
    return rows + rows[:5]


def found(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in repair.repair_conversations(df).collect()), key=repr)


def test_table_equals_brute_force(spark):
    rows = rows_of(1, 150) + [(0, 9000, "word " * 20000 + ".", "user", "z", 1), (1, 9000, "word " * 20000, "assistant", "z", 1)]
    assert found(spark, rows, 4) == brute(rows)
    assert found(spark, [], 1) == []


def test_open_conversations_give_the_same_rows(spark, monkeypatch):
    """Small blocks and little memory, a conversation that fills many ranges, ranges that AQE does not join."""
    monkeypatch.setattr(repair, "HELD_ROWS", 6)
    monkeypatch.setattr(repair, "BLOCK", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = rows_of(2, 60, 400)
        assert found(spark, rows, 6) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_of_which_all_rows_are_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(turn, 5, "Hi.", "user", "z", 1)]
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, rows, 1) == [(5, 0, 0, 0, 0, 0, 0, "", empty)]
    more = rows + [(t, c, "Hi.", "user", "z", 1) for c in (4, 6) for t in range(3)]
    assert (5, 0, 0, 0, 0, 0, 0, "", empty) in found(spark, more, 1) and found(spark, more, 1) == brute(more)

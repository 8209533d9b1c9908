import hashlib
import zlib

import pytest

from tickloom.llm import merkle_manifest as merkle

SCHEMA = "lang string, doc_id bigint, source string, n_chars bigint, text string, leaf string, pos int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Leaves, whole levels and paths with plain lists."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run, slot = nodes[i - i % 8 : i - i % 8 + 8], i % 8
            out.append((run[:slot], run[slot + 1 :]))
            i //= 8
        return out

    trees, out = {}, []
    for lang in sorted({r[0] for r in rows}, key=lambda v: (v is not None, (v or "").encode())):
        own = [(r, coded((r[1], r[2], r[0], r[3], r[4]))) for r in rows if r[0] == lang]
        own.sort(key=lambda p: (p[0][1] is not None, p[0][1] or 0, p[1]))
        trees[lang] = own, tree([d for _, d in own])
    roots = tree([levels[-1][0] for _, levels in trees.values()])
    for k, (lang, (own, levels)) in enumerate(trees.items()):
        for i, (r, leaf) in enumerate(own):
            steps = path(levels, i) + path(roots, k)
            digest = leaf
            if r[1] is not None and zlib.crc32(str(r[1]).encode()) % 3 == 0:
                digest = coded((r[1], r[2], r[0], r[3], lowered(r[4])))
            for left, right in steps:
                digest = sha("".join(left) + digest + "".join(right))
            root = roots[-1][0]
            out.append((r[1], leaf, levels[-1][0], root, sha("".join(d for a, b in steps for d in a + b)), digest, digest == root))
    return sorted(out, key=repr)


def rows_of(count, langs):
    rows = [(langs[i * i % len(langs)] if i % 3 else langs[0], i * 7 % 1001, "web" if i % 5 else None, i if i % 4 else None, f"Text Ä{i} B" * (i % 4)) for i in range(count)]
    return rows + rows[:3] + [(langs[0], None, None, None, None), (langs[0], None, "x", 1, "no id"), (langs[-1], 5, "a", 2, ""), (langs[-1], 6, "a", 2, "Long " * 40000)]


@pytest.mark.parametrize("count,langs,height", [(300, ["en", None, "ü", "de"], 1), (700, ["en", "a"], 2), (90, [f"l{i}" for i in range(40)], 1), (0, ["en"], 4), (250, ["en", "fr"], 4)])
def test_table_equals_brute_force(spark, monkeypatch, count, langs, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = rows_of(count, langs)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in merkle.proofs(docs).collect()), key=repr)
    assert got == brute(rows)
    assert not count or {r[-1] for r in got} == {True, False}


def test_manifest_paths_lead_to_the_root(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows_of(80, ["en", "fr", "es"])], SCHEMA)
    for r in merkle.manifest(docs).collect():
        assert merkle.fold(r.leaf, [s.asDict() for s in r.path]) == r.root
    assert merkle.proofs(docs.limit(0)).count() == 0


def test_one_row_is_its_own_root(spark):
    row = merkle.proofs(spark.createDataFrame([("en", 1, None, None, None, "x", 1)], SCHEMA)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("")


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 64, 65, 511, 513, 600])
def test_the_queue_holds_one_run_a_level(monkeypatch, count):
    most, push = 0, merkle.heapq.heappush

    def watched(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", watched)
    height = merkle.height_of(count)
    top, children = merkle.forward([sha(str(i)) for i in range(count)], height)
    assert most <= 8 * max(height, 1)
    leaves = [sha(str(i)) for i in range(count)]
    assert all(merkle.fold(d, p) == top for d, p in zip(leaves, merkle.backward(children, count, height, []), strict=True))

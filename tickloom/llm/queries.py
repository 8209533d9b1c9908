"""Registered queries of the document operators and the SQL they are checked against.

The others have no SQL form (trained scores, public tokenizers, alignments, automata) and are tested against brute force.
"""

from __future__ import annotations

import corpus_pipeline
from tickloom.llm import bag_minhash, bpe_automaton, conversation_repair, decontamination, fertility, gated_toxicity, license_templates, longest_match, merkle_manifest, pairwise_quality, piece_spans, suffix_repeats, token_blocks
from tickloom.llm.common import documents


def op1_gated_toxicity(spark, sf_dir):
    return gated_toxicity.score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_fertility(spark, sf_dir):
    return fertility.quality_rules(documents(spark, sf_dir))


def op3_pairwise_quality(spark, sf_dir):
    return pairwise_quality.score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_bag_minhash(spark, sf_dir):
    return bag_minhash.near_duplicates(documents(spark, sf_dir))


def op5_token_blocks(spark, sf_dir):
    return token_blocks.token_files(documents(spark, sf_dir))


def op6_suffix_repeats(spark, sf_dir):
    return suffix_repeats.removal_digests(documents(spark, sf_dir))


def op7_license_templates(spark, sf_dir):
    return license_templates.scan_licenses(documents(spark, sf_dir)).drop("spans")


def op8_bpe_automaton(spark, sf_dir):
    return bpe_automaton.token_digests(documents(spark, sf_dir))


def op9_decontamination(spark, sf_dir):
    return decontamination.leaked_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op10_longest_match(spark, sf_dir):
    return longest_match.count_tokens(documents(spark, sf_dir))


def op11_piece_spans(spark, sf_dir):
    return piece_spans.piece_digests(documents(spark, sf_dir))


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest.proofs(documents(spark, sf_dir))


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(documents(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_gated_toxicity, op2_fertility, op3_pairwise_quality, op4_bag_minhash, op5_token_blocks, op6_suffix_repeats, op7_license_templates, op8_bpe_automaton, op9_decontamination, op10_longest_match, op11_piece_spans, op12_merkle_manifest, op13_conversation_repair, pipeline,
)
QUERIES = {f.__name__: f for f in OPERATORS}

# Exact similarity of all pairs that share a shingle, then the closure of the links.
NEAR = r"""WITH RECURSIVE d AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
w AS (SELECT row_number() OVER () AS node, text, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS ws FROM d),
s AS (SELECT node, unnest([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)]) AS shingle FROM w WHERE len(ws) > 0),
c AS (SELECT node, shingle, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT node, sum(n) AS total FROM c GROUP BY 1),
p AS (SELECT a.node AS x, b.node AS y, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN t a ON a.node = x JOIN t b ON b.node = y WHERE 5 * common >= 4 * (a.total + b.total - common)),
l AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT node, node AS other FROM w UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.other),
g AS (SELECT node, min(other) AS class FROM r GROUP BY 1),
m AS (SELECT doc_id, class FROM documents JOIN w ON w.text = coalesce(documents.text, '') JOIN g USING (node)),
k AS (SELECT class, min(doc_id) AS class_id, count(*) AS class_size FROM m GROUP BY 1)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM m JOIN k USING (class)"""

# All strings of 200 bytes, as hexadecimal; runs of covered bytes by gaps between starts.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
c AS (SELECT doc_id, n, unnest(range(0, n - 199, 500)) AS part, h FROM b WHERE n >= 200),
z AS MATERIALIZED (SELECT doc_id, n, part, substr(h, 2 * part + 1, 1400) AS piece FROM c),
s AS (SELECT doc_id, part, piece, unnest(range(0, least(500, n - 199 - part))) AS j FROM z),
u AS (SELECT doc_id, part + j AS i, md5(substr(piece, 2 * j + 1, 400)) AS m FROM s),
t AS (SELECT m FROM u GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT doc_id, i FROM u SEMI JOIN t USING (m)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM v),
q AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS first, max(i) + 200 AS stop FROM q GROUP BY 1, 2),
k AS (SELECT doc_id, first, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM r),
j AS (SELECT doc_id, sum(stop - first) AS gone, count(*) AS spans, max(stop) AS last, string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS head FROM k JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN j USING (doc_id)"""



def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text of ASCII characters, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def tree_levels(name: str, source: str, levels: int) -> list[str]:
    """CTEs of the levels over ``source`` (t, i, h, m nodes of the tree) and of what stands before and after each node in its run."""
    out = [f"{name}0 AS MATERIALIZED (SELECT t, i, h, m FROM {source})"]
    for k in range(levels):
        out.append(
            f"""{name}{k + 1} AS MATERIALIZED (SELECT t, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
  (any_value(m) + 7) // 8 AS m FROM {name}{k} GROUP BY t, i // 8)"""
        )
        out.append(
            f"""{name}s{k} AS MATERIALIZED (SELECT a.t, a.i, any_value(a.m) AS m, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.t = b.t AND a.i // 8 = b.i // 8 GROUP BY a.t, a.i)"""
        )
    return out


def tree_paths(name: str, source: str, levels: int) -> list[str]:
    """CTEs that fold x along a path from node p of tree t and gather the siblings in pr."""
    out, before = [], source
    for k in range(levels):
        step = f"{name}p{k}"
        fields = f"z.* EXCLUDE (x, pr), CASE WHEN s.m = 1 THEN x ELSE sha256(s.l || x || s.r) END AS x, CASE WHEN s.m = 1 THEN pr ELSE pr || s.l || s.r END AS pr"
        out.append(f"{step} AS MATERIALIZED (SELECT {fields} FROM {before} z JOIN {name}s{k} s ON s.t = z.t AND s.i = z.p // {8**k})")
        before = step
    return out


def sized(column: str, value: str | None = None) -> str:
    value = value or column
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


# Seven levels hold two million rows a language, three hold 512 languages.
HEAD = " || ".join(sized(c) for c in ("doc_id", "source", "lang", "n_chars"))
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MANIFEST = "WITH " + ",\n".join(
    [
        f"d AS (SELECT doc_id, lang, sha256({HEAD} || {sized('text')}) AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({HEAD} || {sized('text', LOWERED)}) END AS changed FROM documents)",
        "n AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS m FROM d)",
        *tree_levels("a", "(SELECT t, p AS i, leaf AS h, m FROM n)", 7),
        *tree_levels("b", "(SELECT 0 AS t, t AS i, h, count(*) OVER () AS m FROM a7)", 3),
        *tree_paths("a", "(SELECT doc_id, leaf, t, p, coalesce(changed, leaf) AS x, '' AS pr FROM n)", 7),
        *tree_paths("b", "(SELECT doc_id, leaf, t AS lt, 0 AS t, t AS p, x, pr FROM ap6)", 3),
    ]
) + """
SELECT doc_id, leaf, a7.h AS subroot, b3.h AS root, sha256(pr) AS proof_sha256, x AS folded_root, x = b3.h AS verified FROM bp2 JOIN a7 ON a7.t = bp2.lt JOIN b3 ON true"""



def edited(label: str, cost: str, letter: str) -> str:
    """A label (eight digits of cost, then the edits) with one more edit."""
    return f"(lpad(CAST(CAST(substr({label}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({label}, 9) || '{letter}')"


def inserted(a: str, b: str, c: str, d: str) -> str:
    """Labels of the four places once insertions were tried."""
    user = f"least({c}, {edited(a, '5', 'I')}, {edited(b, '5', 'I')}, {edited(d, '5', 'I')})"
    return f"SELECT * EXCLUDE ({a}, {b}, {c}, {d}), {a} AS s0, {b} AS s1, {user} AS s2, least({d}, {edited(user, '5', 'I')}) AS s3"


def row_moves() -> str:
    """Labels after a row (w initial, f fault), before insertions."""
    keep = lambda p, w: f"CASE WHEN f NOT IN ('blank', 'duplicate') AND w = '{w}' THEN {edited(p, 'x', 'K')} END"
    turn = lambda p: f"CASE WHEN f NOT IN ('blank', 'duplicate') THEN {edited(p, '1 + x', 'R')} END"
    user = ", ".join(f"{keep(p, 'u')}, {turn(p)}" for p in ("s0", "s1", "s3"))
    return f"{edited('s0', '2', 'D')} AS n0, least({edited('s1', '2', 'D')}, {keep('s0', 's')}) AS n1, least({edited('s2', '2', 'D')}, {user}) AS n2, least({edited('s3', '2', 'D')}, {keep('s2', 'a')}, {turn('s2')}) AS n3"


# Labels of the places row by row, then the least label of a place that may be the last; the audit's letters meet their rows again.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CONVERSATIONS = f"""WITH RECURSIVE q AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS z FROM conversations),
h AS (SELECT *, {crc32('z')} % 20 AS d FROM q),
g AS (SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS k, rtrim(text, {BLANKS}) AS r FROM g),
v AS MATERIALIZED (SELECT *, left(role, 1) AS w, CASE WHEN r = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN right(r, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) AS lw FROM o),
e AS (SELECT c, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
  count(*) FILTER (lw IS NOT NULL AND lw || w NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM v GROUP BY c),
l AS ({inserted('z0', 'z1', 'z2', 'z3')} FROM (SELECT DISTINCT c, 0 AS k, '00000000' AS z0, CAST(NULL AS VARCHAR) AS z1, CAST(NULL AS VARCHAR) AS z2, CAST(NULL AS VARCHAR) AS z3 FROM q)
  UNION ALL {inserted('n0', 'n1', 'n2', 'n3')} FROM (SELECT l.c, v.k, {row_moves()} FROM l JOIN (SELECT *, CASE WHEN f = 'truncated' THEN 5 ELSE 0 END AS x FROM v) v ON v.c = l.c AND v.k = l.k + 1)),
b AS MATERIALIZED (SELECT c, arg_max(least(s0, s3), k) AS best FROM l GROUP BY c),
t AS (SELECT c, best, p, substr(best, 8 + p, 1) AS a FROM (SELECT *, unnest(range(1, length(best) - 7)) AS p FROM b)),
u AS (SELECT *, count(*) FILTER (a <> 'I') OVER (PARTITION BY c ORDER BY p) AS k, count(*) FILTER (a <> 'D') OVER (PARTITION BY c ORDER BY p) AS j FROM t),
y AS (SELECT u.*, v.role, v.text, v.w, max(CASE WHEN u.j = 1 AND a = 'K' AND v.w = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.c) AS s FROM u LEFT JOIN v ON v.c = u.c AND v.k = u.k),
m AS (SELECT c, string_agg(CASE WHEN a = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN a = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS lines
  FROM y WHERE a <> 'D' GROUP BY c)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(substr(best, 1, 8) AS BIGINT) AS cost, substr(best, 9) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM q) n JOIN b USING (c) LEFT JOIN e USING (c) LEFT JOIN m USING (c)"""

SQL: dict[str, str] = {"op4_bag_minhash": NEAR, "op6_suffix_repeats": REPEATS, "op12_merkle_manifest": MANIFEST, "op13_conversation_repair": CONVERSATIONS}

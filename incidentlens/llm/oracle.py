"""DuckDB counterparts of the queries that SQL can express, straight from their definitions."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(%s, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1 = f"""
WITH item_words AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM item_words WHERE len(ws) > 0)),
doc_words AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT d.*, s.n, unnest(range(1, len(ws) - s.n + 2)) AS i
        FROM doc_words d, (SELECT DISTINCT n FROM item_windows) s WHERE len(ws) >= s.n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def _components(length: int, percent: int) -> str:
    """Documents linked by the similarity of their sets of shingles, from all pairs that share one."""
    return f"""
WITH RECURSIVE doc_words AS (SELECT doc_id, {_WORDS % _LOWER} AS ws FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {length} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {length} + 2), lambda i: array_to_string(ws[i:i + {length} - 1], ' ')) END)) AS s
  FROM doc_words),
heads AS (SELECT s, min(doc_id) AS head FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT head, len(s) AS n, unnest(s) AS t FROM heads),
common AS (
  SELECT a.head AS a, b.head AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.t = b.t AND a.head < b.head AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(head, other) AS (
  SELECT head, head FROM heads
  UNION SELECT r.head, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
roots AS (SELECT head, min(other) AS root FROM reach GROUP BY head)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN heads ON sets.s = heads.s LEFT JOIN roots USING (head)
"""


OP4 = _components(5, 80)
_OP12 = _components(3, 85)
OP12 = f"SELECT *, doc_id = component_id AS kept FROM ({_OP12})"

OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + 2 * length(role) - length(translate(role, '\#<' || chr(10), ''))
                + 2 * length(text) - length(translate(text, '\#<', ''))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP6 = f"""
WITH doc_words AS (SELECT doc_id, {_WORDS % "coalesce(text, '')"} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM doc_words WHERE len(ws) >= 20)),
firsts AS (SELECT win, min((doc_id, i)) AS head FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j
  FROM windows JOIN firsts USING (win) WHERE (doc_id, i) <> head),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM doc_words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (doc_id)
"""


def _encoded(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = " || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars")))
_TAMPERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """CTEs ``name`` (all nodes of trees of arity 8) and ``name_runs`` (their runs)."""
    return f"""
{name}(g, lvl, idx, held, digest) AS (
  SELECT g, 0, idx, held, digest FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, idx // 8, (held + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE held > 1 GROUP BY g, lvl, idx // 8, held),
{name}_runs AS (
  SELECT g, lvl, idx // 8 AS run, list(digest ORDER BY idx) AS members
  FROM {name} WHERE held > 1 GROUP BY g, lvl, idx // 8)"""


def _walk(name: str, start: str, tree: str) -> str:
    """CTEs ``name`` and ``name_end``: from (id, g, idx, proof, fold) of ``start`` up to the top of its tree."""
    return f"""
{name}(id, g, lvl, idx, proof, fold) AS (
  SELECT id, g, 0, idx, proof, fold FROM {start}
  UNION ALL
  SELECT w.id, w.g, w.lvl + 1, w.idx // 8,
         w.proof || array_to_string(list_concat(r.members[1:w.idx % 8], r.members[w.idx % 8 + 2:]), ''),
         sha256(array_to_string(list_concat(r.members[1:w.idx % 8], [w.fold], r.members[w.idx % 8 + 2:]), ''))
  FROM {name} w JOIN {tree}_runs r ON r.g = w.g AND r.lvl = w.lvl AND r.run = w.idx // 8),
{name}_end AS (SELECT id, g, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM {name} GROUP BY id, g)"""


# The table of CRC-32 follows from its polynomial, bit by bit.
OP11 = f"""
WITH RECURSIVE crc_bits(n, k, c) AS (
  SELECT n, 0, n FROM (SELECT unnest(range(256)) AS n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT n, c FROM crc_bits WHERE k = 8),
docs AS (
  SELECT *, row_number() OVER () AS id, CAST(doc_id AS VARCHAR) AS key,
         sha256({_LEAF} || {_encoded("text")}) AS leaf, sha256({_LEAF} || {_encoded(_TAMPERED)}) AS other
  FROM documents),
crc(id, i, c) AS (
  SELECT id, 0, 4294967295 FROM docs WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s.id, s.i + 1, xor(s.c // 256, t.c)
  FROM crc s JOIN docs d ON d.id = s.id JOIN crc_table t ON t.n = xor(s.c % 256, ascii(d.key[s.i + 1]))
  WHERE s.i < length(d.key)),
tampered AS (SELECT c.id FROM crc c JOIN docs d ON d.id = c.id WHERE c.i = length(d.key) AND xor(c.c, 4294967295) % 3 = 0),
leaves AS (
  SELECT d.id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, leaf AS digest,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS held, CASE WHEN t.id IS NULL THEN leaf ELSE other END AS fold, '' AS proof
  FROM docs d LEFT JOIN tampered t ON t.id = d.id),
{_tree("nodes", "leaves")},
subroots AS (SELECT g AS idx, digest, count(*) OVER () AS held, 0 AS g FROM nodes WHERE held = 1),
{_tree("crown", "subroots")},
{_walk("low", "leaves", "nodes")},
mid AS (SELECT id, 0 AS g, g AS idx, proof, fold FROM low_end),
{_walk("high", "mid", "crown")}
SELECT d.doc_id, d.leaf, s.digest AS subroot, c.digest AS root, sha256(h.proof) AS proof_sha256, h.fold AS folded_root,
       h.fold = c.digest AS verified
FROM docs d JOIN leaves l ON l.id = d.id JOIN subroots s ON s.idx = l.g JOIN high_end h ON h.id = d.id
CROSS JOIN (SELECT digest FROM crown WHERE held = 1) c
"""

OP13 = """
WITH usable AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

STATEMENTS = {
    "op1_decontaminate": OP1,
    "op4_ngram_join": OP4,
    "op5_chat_format": OP5,
    "op6_substring": OP6,
    "op11_merkle": OP11,
    "op12_minhash": OP12,
    "op13_hard_negatives": OP13,
}

"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from .chat import CONTROLS

_OP2 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.owner IS NOT NULL AND f.owner <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for x in CONTROLS:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


_OP9 = f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT conv_id, turn, role, text, role = 'assistant' AS learn,
         length({_escaped("role")}) + length({_escaped("text")}) + 8 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (learn), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (learn), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (learn OR back = 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


_OP11 = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT node AS vec_id, coalesce(links, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node
"""

#: CRC-32 of a list of bytes, step by step over the table for one byte.
_CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""


def _crc(data: str, table: str = "t") -> str:
    """SQL for the CRC-32 of ``data``, a list of BIGINTs from 0 to 255."""
    return f"xor(list_reduce({data}, lambda c, b: xor({table}[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295)"


_DIGITS = "list_transform(string_split(c.conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"

_OP12 = f"""
WITH {_CRC_TABLE},
t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
h AS (SELECT c.conv_id, c.base, {_crc(_DIGITS)} % 4 AS h FROM c, crc_table),
w AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
r AS (SELECT conv_id, row_number() OVER o AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
             string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER o AS key
      FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (SELECT conv_id, depth, words, sha256(key) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
m AS (
  SELECT p.depth, p.key, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, max(l.n) AS deepest,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.n = p.depth), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY p.depth, p.key),
s AS (
  SELECT a.depth, a.key, sum((m.n_convs - 1) * m.words) AS saved, count(*) FILTER (m.deepest = m.depth) AS n_leaves, count(*) FILTER (m.depth = a.depth + 1) AS n_children
  FROM m JOIN p a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.depth, a.key)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, s.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, key)
LEFT JOIN p u ON u.conv_id = m.conv_id AND u.depth = m.depth - 1
LEFT JOIN m up ON up.depth = u.depth AND up.key = u.key
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
_BYTES = "list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)"

_OP13 = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM d),
dn AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY doc_id, f),
bn AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM b) GROUP BY f),
u AS (SELECT f FROM dn UNION SELECT f FROM bn),
h AS (SELECT f, {_crc(_BYTES)} % 10000 AS bucket FROM u, crc_table),
sc AS (SELECT bucket, sum(n) AS n FROM dn JOIN h USING (f) GROUP BY bucket),
tc AS (SELECT bucket, sum(n) AS n FROM bn JOIN h USING (f) GROUP BY bucket),
g AS (
  SELECT r.bucket, floor(1000 * ln(((coalesce(tc.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM sc) + 10000))::DOUBLE / ((coalesce(sc.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM tc) + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(10000) r(bucket) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket)),
x AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM dn JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
y AS (
  SELECT d.doc_id, len(d.w) >= 20 AS open, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (open) OVER () // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= drawn THEN place END AS rank FROM z
"""

ORACLES = {"op2_line_dedup": _OP2, "op9_chat": _OP9, "op11_embedding_dups": _OP11, "op12_prefix_trie": _OP12, "op13_importance": _OP13}

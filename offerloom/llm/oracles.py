"""SQL definitions of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 AS size, unnest(range(0, length(h) // 2, 500)) AS base, h FROM d),
q AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1198) AS part, least(500, size - 99 - base) AS starts FROM c),
p AS (SELECT doc_id, base, part, unnest(range(0, greatest(starts, 0))) AS o FROM q),
f AS (SELECT doc_id, base + o AS i,
             row_number() OVER (PARTITION BY substr(part, 2 * o + 1, 200) ORDER BY doc_id, base + o) AS n FROM p),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT s.doc_id, a, b, h, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS from_
      FROM s JOIN d USING (doc_id)),
j AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
             string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept
      FROM k GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""

_FINITE = """embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

ORACLES["op5_embedding_join"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

ORACLES["op6_topk"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_RENDERED = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"

ORACLES["op8_preferences"] = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (ORDER BY md5(text), conv_id) - 1 AS place FROM t WHERE i = 1),
p AS (SELECT place // 2 AS pair_id, min(CASE WHEN place % 2 = 0 THEN conv_id END) AS chosen_id,
             min(CASE WHEN place % 2 = 1 THEN conv_id END) AS rejected_id FROM o GROUP BY 1),
a AS (SELECT pair_id, t.* FROM p JOIN t ON t.conv_id = chosen_id),
b AS (SELECT pair_id, t.* FROM p JOIN t ON t.conv_id = rejected_id),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id,
             min(CASE WHEN a.i IS NULL OR b.i IS NULL OR a.role <> b.role OR a.text <> b.text
                      THEN coalesce(a.i, b.i) ELSE coalesce(a.i, b.i) + 1000000000 END) AS first,
             max(coalesce(a.i, b.i)) AS last
      FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1),
n AS (SELECT pair_id, CASE WHEN first > 1000000000 THEN last ELSE first - 1 END AS n_prefix FROM m),
w AS (SELECT pair_id, 'a' AS side, i, role, text FROM a UNION ALL SELECT pair_id, 'b', i, role, text FROM b),
y AS (SELECT w.*, i <= n_prefix AS shared, {_RENDERED} AS piece,
             coalesce(sum(CASE WHEN i > n_prefix THEN length({_RENDERED}) ELSE 0 END) OVER (
               PARTITION BY w.pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
      FROM w JOIN n ON w.pair_id = n.pair_id),
z AS (SELECT pair_id, side, coalesce(string_agg(CASE WHEN shared THEN piece END, '' ORDER BY i), '') AS prompt,
             coalesce(string_agg(CASE WHEN NOT shared THEN piece END, '' ORDER BY i), '') AS completion,
             coalesce(string_agg(CASE WHEN NOT shared AND role = 'assistant'
               THEN (base + length(role) + 5)::BIGINT || ':' || (base + length(piece))::BIGINT END, ',' ORDER BY i), '') AS mask
      FROM y GROUP BY pair_id, side)
SELECT p.pair_id::BIGINT AS pair_id, chosen_id, rejected_id, n_prefix::INTEGER AS n_prefix, za.prompt,
       za.completion AS chosen, za.mask AS chosen_mask,
       coalesce(zb.completion, '') AS rejected, coalesce(zb.mask, '') AS rejected_mask
FROM p JOIN n ON p.pair_id = n.pair_id JOIN z za ON za.pair_id = p.pair_id AND za.side = 'a'
LEFT JOIN z zb ON zb.pair_id = p.pair_id AND zb.side = 'b'
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op12_phrases"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: list_slice(ws, i, i + k - 1))) AS words
      FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, words, array_to_string(words, ' ') AS phrase, count(*) AS n FROM g GROUP BY lang, k, words),
c AS (SELECT * FROM f WHERE k >= 2 AND n >= 30),
i AS (SELECT lang, n, array_to_string(list_slice(words, x.x, x.x + m.m - 1), ' ') AS phrase
      FROM c, (VALUES (2), (3)) AS m(m), (VALUES (1), (2), (3)) AS x(x) WHERE m.m < k AND x.x + m.m - 1 <= k),
o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN i ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100 * i.n >= 80 * c.n),
u AS (SELECT c.lang, c.phrase, c.n AS a, j.j, array_to_string(list_slice(c.words, 1, j.j), ' ') AS head,
             array_to_string(list_slice(c.words, j.j + 1, k), ' ') AS tail
      FROM c, (VALUES (1), (2), (3)) AS j(j)
      WHERE j.j < k AND NOT EXISTS (SELECT 1 FROM o WHERE o.lang = c.lang AND o.phrase = c.phrase)),
s AS (SELECT u.lang, u.phrase, a, j, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = head JOIN f y ON y.lang = u.lang AND y.phrase = tail),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM s),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT q.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n,
       score::BIGINT AS score
FROM q JOIN t ON q.lang = t.lang WHERE rank <= 2000
"""

ORACLES["op13_infill"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
v AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS a,
             array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS m,
             array_to_string(list_slice(u, greatest(c1, c2) + 1, len(u)), '') AS z,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM v)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

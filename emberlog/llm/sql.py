"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

PREFIX_TRIE = rf"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)
), own AS (
  SELECT conv_id AS conv, coalesce(text, '') AS text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv, conv - conv % 20 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(conv::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv FROM own) CROSS JOIN crc_table
), taken AS (
  SELECT c.conv, o.pos, o.key, o.text FROM conv c JOIN own o ON o.conv = c.base AND o.pos <= c.h
), shift AS (
  SELECT c.conv, c.h, (SELECT count(*) FROM taken t WHERE t.conv = c.conv) AS n FROM conv c
), built AS (
  SELECT * FROM taken
  UNION ALL
  SELECT o.conv, o.pos - s.h + s.n, o.key, o.text FROM own o JOIN shift s USING (conv) WHERE o.pos > s.h
), member AS (
  SELECT conv, 0 AS depth, '' AS prefix, 0 AS words FROM conv
  UNION ALL
  SELECT conv, pos, array_to_string(list(key) OVER (PARTITION BY conv ORDER BY pos), ','), length(regexp_extract_all(text, '{WORD}')) FROM built
), node AS (
  SELECT depth, prefix, min(conv) AS id, count(*) AS n, max(words) AS words FROM member GROUP BY depth, prefix
), place AS (
  SELECT m.conv, m.depth, n.id, m.depth = max(m.depth) OVER (PARTITION BY m.conv) AS ends FROM member m JOIN node n USING (depth, prefix)
), parent AS (
  SELECT n.depth, n.id, p.id AS parent FROM node n LEFT JOIN place p ON p.conv = n.id AND p.depth = n.depth - 1
), kids AS (
  SELECT depth - 1 AS depth, parent AS id, count(*) AS n_children FROM parent WHERE parent IS NOT NULL GROUP BY ALL
), rolled AS (
  SELECT a.depth, a.id, sum((n.n - 1) * n.words) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM node n JOIN place a ON a.conv = n.id AND a.depth <= n.depth LEFT JOIN kids k ON k.depth = n.depth AND k.id = n.id
  GROUP BY a.depth, a.id
), ended AS (
  SELECT depth, id, string_agg(conv::VARCHAR, ',' ORDER BY conv) AS ids FROM place WHERE ends GROUP BY depth, id
)
SELECT n.id AS conv_id, n.depth::BIGINT AS depth, p.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
  r.n_leaves, r.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node n JOIN parent p USING (depth, id) JOIN rolled r USING (depth, id) LEFT JOIN kids k USING (depth, id) LEFT JOIN ended e USING (depth, id)
"""

PHRASES = r"""
WITH words AS (
  SELECT lang, doc, piece, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (
    SELECT lang, doc, piece, regexp_extract_all(part, '[^\x20\x09]+') AS w
    FROM (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part,
        generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.,;:!?\x0A-\x0D]'), 1) AS piece
      FROM documents
    )
  )
), grams AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc, piece ORDER BY pos)
), single AS (
  SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL
), pair AS (
  SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), triple AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT p.lang, w1 || ' ' || w2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r
  FROM pair p JOIN single x USING (lang, w1) JOIN single y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (
    SELECT 1 FROM triple t WHERE t.lang = p.lang AND (t.w1 = p.w1 AND t.w2 = p.w2 OR t.w2 = p.w1 AND t.w3 = p.w2) AND 100 * t.f >= 50 * p.f
  )
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM triple t JOIN single x USING (lang, w1) JOIN pair y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM triple t JOIN pair x USING (lang, w1, w2) JOIN single y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), least AS (
  SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM single GROUP BY lang) USING (lang)
WHERE rank <= 2000
"""

SQL = {"op11_phrase_collocations": PHRASES, "op12_prefix_trie": PREFIX_TRIE}

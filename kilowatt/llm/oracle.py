"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

# every run of words from each word on, then counts, cuts and covered phrases
PHRASES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (
  SELECT doc, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS words FROM docs),
split AS (
  SELECT doc, lang, piece, string_split_regex(words, '[\x20\x09]+') AS words FROM pieces),
words AS (
  SELECT doc, lang, piece, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM split),
runs AS (
  SELECT lang, word AS w1, lead(word, 1) OVER one AS w2, lead(word, 2) OVER one AS w3, lead(word, 3) OVER one AS w4
  FROM words WHERE word <> '' WINDOW one AS (PARTITION BY doc, piece ORDER BY pos)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL),
f4 AS MATERIALIZED (SELECT lang, w1, w2, w3, w4, count(*) AS f FROM runs WHERE w4 IS NOT NULL GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.w1, p.w2, NULL AS w3, NULL AS w4, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON p.lang = x.lang AND p.w1 = x.w1 JOIN f1 y ON p.lang = y.lang AND p.w2 = y.w1 WHERE p.f >= 30
  UNION ALL
  SELECT p.lang, p.w1, p.w2, p.w3, NULL, p.f, 1, x.f, y.f
  FROM f3 p JOIN f1 x ON p.lang = x.lang AND p.w1 = x.w1 JOIN f2 y ON p.lang = y.lang AND p.w2 = y.w1 AND p.w3 = y.w2 WHERE p.f >= 30
  UNION ALL
  SELECT p.lang, p.w1, p.w2, p.w3, NULL, p.f, 2, x.f, y.f
  FROM f3 p JOIN f2 x ON p.lang = x.lang AND p.w1 = x.w1 AND p.w2 = x.w2 JOIN f1 y ON p.lang = y.lang AND p.w3 = y.w1 WHERE p.f >= 30
  UNION ALL
  SELECT p.lang, p.w1, p.w2, p.w3, p.w4, p.f, 1, x.f, y.f
  FROM f4 p JOIN f1 x ON p.lang = x.lang AND p.w1 = x.w1
  JOIN f3 y ON p.lang = y.lang AND p.w2 = y.w1 AND p.w3 = y.w2 AND p.w4 = y.w3 WHERE p.f >= 30
  UNION ALL
  SELECT p.lang, p.w1, p.w2, p.w3, p.w4, p.f, 2, x.f, y.f
  FROM f4 p JOIN f2 x ON p.lang = x.lang AND p.w1 = x.w1 AND p.w2 = x.w2
  JOIN f2 y ON p.lang = y.lang AND p.w3 = y.w1 AND p.w4 = y.w2 WHERE p.f >= 30
  UNION ALL
  SELECT p.lang, p.w1, p.w2, p.w3, p.w4, p.f, 3, x.f, y.f
  FROM f4 p JOIN f3 x ON p.lang = x.lang AND p.w1 = x.w1 AND p.w2 = x.w2 AND p.w3 = x.w3
  JOIN f1 y ON p.lang = y.lang AND p.w4 = y.w1 WHERE p.f >= 30),
lowest AS (
  SELECT *, (2000000::HUGEINT * a) // (l + r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3, w4 ORDER BY (2000000::HUGEINT * a) // (l + r), k) = 1),
longer AS (
  SELECT lang, w1, w2, NULL AS w3, f FROM f3 WHERE f >= 30
  UNION ALL SELECT lang, w2, w3, NULL, f FROM f3 WHERE f >= 30
  UNION ALL SELECT lang, w1, w2, NULL, f FROM f4 WHERE f >= 30
  UNION ALL SELECT lang, w2, w3, NULL, f FROM f4 WHERE f >= 30
  UNION ALL SELECT lang, w3, w4, NULL, f FROM f4 WHERE f >= 30
  UNION ALL SELECT lang, w1, w2, w3, f FROM f4 WHERE f >= 30
  UNION ALL SELECT lang, w2, w3, w4, f FROM f4 WHERE f >= 30),
most AS (SELECT lang, w1, w2, w3, max(f) AS f FROM longer GROUP BY ALL),
kept AS (
  SELECT p.lang, concat_ws(' ', p.w1, p.w2, p.w3, p.w4) AS phrase, p.a, p.l, p.r, p.score
  FROM lowest p LEFT JOIN most m
    ON p.w4 IS NULL AND p.lang = m.lang AND p.w1 = m.w1 AND p.w2 = m.w2 AND p.w3 IS NOT DISTINCT FROM m.w3 AND 100 * m.f >= 80 * p.a
  WHERE m.f IS NULL),
sizes AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, k.l, k.r, s.n::BIGINT AS n, k.score::BIGINT AS score
FROM kept k JOIN sizes s ON k.lang = s.lang
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrases": PHRASES}

"""op11: the strongest phrases of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.collocations import collocations
from tallyguard.llm.frames import LOWER, UPPER, table
from tallyguard.llm.queries import query

_SQL = rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM cut
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), totals AS (
  SELECT lang, count(*) AS n FROM starts GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), candidates AS (
  SELECT * FROM grams WHERE k > 1 AND f >= 100
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND o.f >= c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k, unnest(range(1, k)) AS cut FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, c.cut, CAST((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).drop("k")

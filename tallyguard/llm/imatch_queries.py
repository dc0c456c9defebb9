"""op10: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import table
from tallyguard.llm.imatch import compare_with_edits
from tallyguard.llm.queries import query

_TERMS = r"list_filter(list_distinct(regexp_split_to_array(lower({}), '[\x20\x09-\x0D]+')), lambda x: x <> '')"

_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
ordered AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d
), texts AS (
  SELECT doc_id, n, text, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited FROM ordered
), counted AS (
  SELECT term, count(*) AS df FROM (SELECT unnest({_TERMS.format("text")}) AS term FROM d) GROUP BY term
), lexicon AS (
  SELECT term, printf('%02x', CAST('0x' || substr(md5(term), 1, 4) AS INT) % 96) AS class FROM counted
  WHERE df >= 2 AND df * 1000 >= (SELECT count(*) FROM d) AND df * 20 <= (SELECT count(*) FROM d)
), both_texts AS (
  SELECT doc_id, 0 AS which, text FROM texts UNION ALL SELECT doc_id, 1, edited FROM texts
), terms AS (
  SELECT doc_id, which, unnest({_TERMS.format("text")}) AS term FROM both_texts
), sums AS (
  SELECT doc_id, which, class, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS part
  FROM terms LEFT JOIN lexicon USING (term) GROUP BY doc_id, which, class
), prints AS (
  SELECT b.doc_id, b.which,
    coalesce(list(class || ':' || part ORDER BY class) FILTER (class IS NOT NULL),
             ['text:' || coalesce(max(part) FILTER (class IS NULL), substr(md5(''), 1, 8))]) AS blocks
  FROM both_texts b LEFT JOIN sums USING (doc_id, which) GROUP BY b.doc_id, b.which
), joined AS (
  SELECT t.doc_id, t.n, t.edited, a.blocks AS own, e.blocks AS edited_blocks,
    coalesce(lead(a.blocks) OVER (ORDER BY t.doc_id), first_value(a.blocks) OVER (ORDER BY t.doc_id)) AS next_blocks
  FROM texts t JOIN prints a ON a.doc_id = t.doc_id AND a.which = 0 JOIN prints e ON e.doc_id = t.doc_id AND e.which = 1
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(own, ' ') AS fingerprint, array_to_string(edited_blocks, ' ') AS edited_fingerprint,
  len(list_intersect(own, edited_blocks)) / len(list_distinct(list_transform(own || edited_blocks, lambda x: split_part(x, ':', 1)))) AS near_edited,
  len(list_intersect(own, next_blocks)) / len(list_distinct(list_transform(own || next_blocks, lambda x: split_part(x, ':', 1)))) AS near_next
FROM joined
"""


@query("op10_document_fingerprints", _SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))

"""op4: benchmark items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.decontaminate import contained_items
from tallyguard.llm.frames import LOWER, UPPER, table
from tallyguard.llm.queries import query


def _shingles(name: str, key: str, source: str) -> str:
    """Distinct 5-word shingles by id; a text of fewer words is one shingle. Only A-Z are lowered."""
    return f"""{name}_words AS (
  SELECT {key}, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {source} WHERE text IS NOT NULL
), {name} AS (
  SELECT DISTINCT {key}, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram, least(len(w), 5) AS width
  FROM {name}_words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
)"""


_SQL = f"""
WITH {_shingles("items", "item_id", "benchmark")},
{_shingles("docs", "doc_id", "documents")},
sizes AS (SELECT item_id, count(*) AS item_shingles FROM items GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM docs JOIN items USING (gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= 0.75 * item_shingles
"""


@query("op4_benchmark_decontamination", _SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))

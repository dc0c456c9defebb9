"""op6: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import table
from tallyguard.llm.jaccard_join import near_duplicate_components
from tallyguard.llm.queries import query


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""op13: near-duplicate components of all documents from signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import table
from tallyguard.llm.minhash_join import near_duplicates
from tallyguard.llm.queries import query


@query("op13_minhash_near_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

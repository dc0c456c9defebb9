"""op3: model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.context_tree import score_documents
from tallyguard.llm.frames import table
from tallyguard.llm.queries import query


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )

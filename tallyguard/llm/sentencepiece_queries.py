"""op7: piece ids of all documents, and whether they decode to the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import table
from tallyguard.llm.queries import query
from tallyguard.llm.sentencepiece_codec import round_trip


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_pieces", "pieces", "round_trip")

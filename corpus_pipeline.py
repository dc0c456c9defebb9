"""Corpus cleaning in stages; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm import toxicity as tox
from tallyguard.llm.decontaminate import decontaminate
from tallyguard.llm.frames import stored, table
from tallyguard.llm.jaccard_join import one_of_each
from tallyguard.llm.line_dedup import drop_repeated_lines
from tallyguard.llm.sentencepiece_codec import round_trip
from tallyguard.session import configure

# Trained models and sketches decide in these stages: SQL cannot express them.
ORACLE_SQL: str | None = None

TOXIC_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches TOXIC_FROM go. The model is fitted on the labelled ones among ``docs``."""
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return tox.score(docs, model, keep=tuple(docs.columns)).filter(F.col("tox_score") < TOXIC_FROM).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with n_chars counted anew."""
    cleaned = drop_repeated_lines(docs).select(docs.columns)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the 5-word shingle join at 0.75 stays, the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item to 0.75 go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, and whether they decode to the text."""
    return round_trip(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

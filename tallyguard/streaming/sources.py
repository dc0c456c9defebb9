"""Streaming sources: Kafka with Avro where the packages are there, file streams otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Topics and where each consumer starts without committed offsets.
TOPICS = {
    "raw": "transactions.raw",
    "enriched": "transactions.enriched",
    "features": "features.updates",
    "decisions": "fraud.decisions",
    "alerts": "fraud.alerts",
}
STARTING_OFFSETS = {
    "flink-enrichment": "latest",
    "fraud-alerts": "latest",
    "scoring-realtime": "earliest",
    "audit-writer": "earliest",
}
TRANSACTION_DELAY = "5 seconds"
DECISION_DELAY = "10 seconds"


def start_position(consumer: str) -> str:
    """Where a new query starts; once it has a checkpoint, the checkpoint decides."""
    return STARTING_OFFSETS.get(consumer, "latest")


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topics: Sequence[str],
    consumer: str,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Kafka records of one or several topics; needs Spark's Kafka package on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", start_position(consumer))
        .option("includeHeaders", "true")
    )
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load()


def avro_values(records: DataFrame, avro_schema: str) -> DataFrame:
    """Decode the Avro value of Kafka records; needs Spark's Avro package."""
    from pyspark.sql.avro.functions import from_avro

    decoded = from_avro("value", avro_schema, {"mode": "PERMISSIVE"})
    return records.select("topic", "offset", "headers", decoded.alias("_value")).select("topic", "offset", "headers", "_value.*")


def json_values(records: DataFrame, schema: StructType) -> DataFrame:
    decoded = F.from_json(F.col("value").cast("string"), schema)
    return records.select("topic", "offset", "headers", decoded.alias("_value")).select("topic", "offset", "headers", "_value.*")


def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def with_event_time(df: DataFrame, ts_ms: str = "ts_ms", column: str = "event_time", delay: str = TRANSACTION_DELAY) -> DataFrame:
    """Event time from the millisecond column, with its watermark."""
    return df.withColumn(column, F.timestamp_millis(ts_ms)).withWatermark(column, delay)


def without_redelivered(df: DataFrame, key: str = "tx_id") -> DataFrame:
    """Drop copies of a transaction that arrive within the watermark delay."""
    return df.dropDuplicatesWithinWatermark([key])

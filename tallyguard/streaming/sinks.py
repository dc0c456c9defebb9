"""Streaming sinks. Every file sink of a micro-batch writes its own partition, named by the batch,
and overwrites it on a retry: a batch that runs twice leaves one copy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tallyguard.operators.audit import Failure, analytics_rows, append_monthly, audit_rows, split_dead_letters, upsert_batch, written_batch
from tallyguard.streaming.sources import TOPICS

BatchSink = Callable[[DataFrame, int], None]

# Fixed value: how often a stream saves its state.
CHECKPOINT_INTERVAL = "30 seconds"


def table_sink(path: str, writer: str = "stream") -> BatchSink:
    """Upserts under ``writer``: one name for each query and checkpoint that writes to the table."""
    return lambda batch, batch_id: upsert_batch(batch, path, batch_id, writer)


def kafka_sink(servers: str, topic: str | None = None) -> BatchSink:
    """Rows (key, value and, without ``topic``, a topic column) to Kafka."""

    def write(batch: DataFrame, _: int) -> None:
        writer = batch.write.format("kafka").option("kafka.bootstrap.servers", servers)
        (writer.option("topic", topic) if topic else writer).save()

    return write


def as_json_records(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def as_avro_records(df: DataFrame, key: str, avro_schema: str) -> DataFrame:
    """Avro values; needs Spark's Avro package."""
    from pyspark.sql.avro.functions import to_avro

    return df.select(F.col(key).cast("string").alias("key"), to_avro(F.struct(*df.columns), avro_schema).alias("value"))


def each(*sinks: BatchSink) -> BatchSink:
    """Fan-out: one evaluation of the micro-batch, written to all sinks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def decisions_with_reply(everything: BatchSink, replies: BatchSink, reply_topic: str = "reply_topic") -> BatchSink:
    """All decisions to one sink; those that name a reply topic also to another, with a ``topic``."""

    def reply(batch: DataFrame, batch_id: int) -> None:
        named = batch.filter(F.col(reply_topic).isNotNull())
        replies(named.withColumn("topic", F.col(reply_topic)).drop(reply_topic), batch_id)

    return each(lambda batch, batch_id: everything(batch.drop(reply_topic), batch_id), reply)


def month_sink(path: str, writer: str = "stream", ts_ms: str = "ts_ms") -> BatchSink:
    """Analytics rows into the month-partitioned table, so that reads by time prune months."""
    return each(lambda batch, batch_id: append_monthly(batch, path, batch_id, writer, ts_ms))


def audit_sink(audit_path: str, analytics_path: str, writer: str = "stream") -> BatchSink:
    """Decisions to the audit table (upsert by transaction) and to the analytics table (by month);
    ``writer`` as for ``table_sink``. The micro-batch is evaluated once and held nowhere: the narrow
    analytics rows come from what was written to the audit table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = audit_rows(batch)
        upsert_batch(rows, audit_path, batch_id, writer)
        written = written_batch(batch.sparkSession, audit_path, batch_id, writer, rows.schema)
        if written is not None:
            timed = analytics_rows(written).withColumn("ts_ms", F.unix_millis("ts"))
            append_monthly(timed, analytics_path, batch_id, writer)

    return write


def dead_letter_sink(good: BatchSink, dead: BatchSink, errors: Column, group: str, topic: str = TOPICS["raw"]) -> BatchSink:
    """Rows with validation errors go to the topic's dead letters, the others on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        passed, failed = split_dead_letters(batch, errors, Failure(topic, group), F.unix_millis(F.current_timestamp()))
        good(passed, batch_id)
        dead(failed, batch_id)

    return each(write)


def start(
    stream: DataFrame,
    sink: BatchSink,
    checkpoint: str,
    name: str,
    interval: str | None = CHECKPOINT_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """Start a query with its own checkpoint; ``available_now`` reads what is there and stops."""
    writer: DataStreamWriter = (
        stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def append_files(stream: DataFrame, path: str, checkpoint: str, name: str, fmt: str = "parquet", available_now: bool = False, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Plain append sink with Spark's own exactly-once file log."""
    writer = (
        stream.writeStream.queryName(name).outputMode("append").format(fmt)
        .option("checkpointLocation", checkpoint).option("path", path)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=CHECKPOINT_INTERVAL)).start()

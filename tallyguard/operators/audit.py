"""Audit trail: rows, upserts, replay, dead letters, retention, timelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyguard.functions.requests import error_text, known_decision
from tallyguard.functions.text import year_month
from tallyguard.operators import skew
from tallyguard.operators.snapshots import latest_per_key

# How long each dataset is kept.
RETENTION = {
    "transactions": "INTERVAL 90 DAYS",
    "audit": "INTERVAL 1 YEAR",
    "analytics": "INTERVAL 24 MONTHS",
    "devices": "INTERVAL 30 DAYS",
}


def audit_rows(decisions: DataFrame) -> DataFrame:
    """Decision records to audit rows; merchant and amount stay empty until joined."""
    return decisions.select(
        "tx_id",
        "card_id",
        F.lit("").alias("merchant_id"),
        F.lit(0).cast("decimal(18,4)").alias("amount"),
        "risk_score",
        "decision",
        F.coalesce(F.col("applied_rules"), F.array().cast("array<string>")).alias("applied_rules"),
        F.coalesce(F.col("model_scores"), F.create_map().cast("map<string,double>")).alias("model_scores"),
        "latency_ms",
        F.timestamp_millis("decision_ms").alias("ts"),
        F.to_json(F.struct(*decisions.columns)).alias("raw_event"),
    )


def analytics_rows(audit: DataFrame) -> DataFrame:
    return audit.select(
        "tx_id",
        "card_id",
        "merchant_id",
        F.col("amount").cast("double").alias("amount"),
        "risk_score",
        "decision",
        "latency_ms",
        "ts",
        F.lit("").alias("country"),
        F.lit("").alias("channel"),
        F.lit("").alias("mcc"),
    )


def replay_events(audit: DataFrame, from_ts: Column, to_ts: Column, scanned: Observation | None = None) -> DataFrame:
    """Decision events rebuilt from the audit rows of a closed time range, all cards."""
    found = audit.filter(F.col("ts").between(from_ts, to_ts))
    if scanned is not None:
        found = found.observe(scanned, F.count(F.lit(1)).alias("rows"))
    return found.select(
        "tx_id",
        "card_id",
        "risk_score",
        known_decision(F.col("decision")).alias("decision"),
        "applied_rules",
        "model_scores",
        "latency_ms",
        F.unix_millis("ts").alias("decision_ms"),
    )


def replay(audit: DataFrame, from_ts: Column, to_ts: Column, target: str) -> dict[str, int]:
    """Append the range to ``target``; both counts come out of the one pass that writes."""
    scanned, published = Observation("scanned"), Observation("published")
    events = replay_events(audit, from_ts, to_ts, scanned).observe(published, F.count(F.lit(1)).alias("rows"))
    events.write.mode("append").parquet(target)
    return {"scanned": scanned.get["rows"], "published": published.get["rows"]}


# --- upsert by transaction -------------------------------------------------------------------


COMPACTED = "=compacted"


def upsert_batch(rows: DataFrame, path: str, batch_id: int, writer: str = "batch") -> None:
    """Write one batch of ``writer`` (the id of a query and its checkpoint; no other may use it).
    Writing the same batch again replaces it, so a redelivered batch changes nothing; rows of one
    transaction in several batches are resolved on reading. No existing file is rewritten, whatever
    the table's size, and no writer can replace what another one, or ``compact``, has written."""
    (
        rows.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("writer", "batch_id")
        .parquet(path)
    )


def written_batch(spark: SparkSession, path: str, batch_id: int, writer: str, schema: StructType) -> DataFrame | None:
    """The rows that ``upsert_batch`` wrote for one batch, read from its folder alone; None where it
    had no rows."""
    typed = StructType([*schema.fields, StructField("writer", StringType()), StructField("batch_id", LongType())])
    try:
        rows = spark.read.schema(typed).option("basePath", path).parquet(f"{path.rstrip('/')}/writer=*/batch_id={batch_id}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter(F.col("writer") == writer).select(*schema.names)


def current_rows(spark: SparkSession, path: str, event_time: str | None = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """The table with one row per transaction: the last state by event time where the table has
    that column, else by batch; of equal ones always the same. ``columns`` beside tx_id are all that
    is exchanged (all of the table if not given), with the row's text to tell equal ones apart."""
    rows = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    own = [c for c in rows.columns if c not in ("writer", "batch_id")]
    kept = own if columns is None else ["tx_id", *[c for c in columns if c != "tx_id"]]
    times = [F.col(event_time).alias("_time")] if event_time in own else []
    tie = F.to_json(F.struct(*own)).alias("_tie")
    rows = rows.select(*kept, *times, (F.col("writer") != COMPACTED).alias("_base"), F.col("batch_id").alias("_batch"), tie)
    order = [c for c in rows.columns if c not in kept]
    newest = F.max_by(F.struct(*[c for c in kept if c != "tx_id"]), F.struct(*order))
    return rows.groupBy("tx_id").agg(newest.alias("_newest")).select("tx_id", "_newest.*").select(*kept)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Fold all batches into a new table. Its rows stand below every later batch of equal time."""
    upsert_batch(current_rows(spark, path), target, 0, COMPACTED)


# --- lookup table -----------------------------------------------------------------------------

# Fixed value: folders of the lookup table; a table keeps the number it was written with.
LOOKUP_BUCKETS = 64


def _bucket(tx_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tx_id.cast("bigint")), F.lit(buckets)).cast("int")


def write_by_transaction(rows: DataFrame, path: str, buckets: int = LOOKUP_BUCKETS) -> None:
    """One row per transaction (see ``current_rows``) in hash buckets of ``tx_id``, sorted by it: a
    lookup lists one folder and the statistics of its files leave one row group. The range exchange
    keeps files even, whatever their number; folders stay few however long the history is."""
    bucketed = rows.withColumn("tx_bucket", _bucket(F.col("tx_id"), buckets))
    ranged = bucketed.repartitionByRange("tx_bucket", "tx_id").sortWithinPartitions("tx_bucket", "tx_id")
    ranged.write.mode("errorifexists").partitionBy("tx_bucket").parquet(path)


def find_transaction(table: DataFrame, tx_id: int, buckets: int = LOOKUP_BUCKETS) -> DataFrame:
    """A transaction's row from the lookup table; reads its bucket only."""
    return by_transaction(table.filter(F.col("tx_bucket") == _bucket(F.lit(tx_id), buckets)), tx_id).drop("tx_bucket")


def find_transactions(table: DataFrame, wanted: DataFrame, buckets: int = LOOKUP_BUCKETS) -> DataFrame:
    """Rows of the lookup table for the ``tx_id`` of ``wanted``, each once; ids without a row, and
    null ids, give none."""
    ids = wanted.select(F.col("tx_id").cast("bigint").alias("_id")).filter("_id IS NOT NULL").distinct()
    ids = ids.withColumn("_of", _bucket(F.col("_id"), buckets))
    on = (F.col("tx_bucket") == F.col("_of")) & (F.col("tx_id") == F.col("_id"))
    return table.join(ids, on, "left_semi").drop("tx_bucket")


# --- month table ------------------------------------------------------------------------------


def write_monthly(rows: DataFrame, path: str, ts_ms: str = "ts_ms", files: int | None = None) -> None:
    """Month partitions sorted by (card, time, transaction). The range exchange gives files of even
    size, also for a month or card with a large share of the rows, with narrow card ranges."""
    order = ["yyyymm", "card_id", ts_ms, "tx_id"]
    rows = rows.withColumn("yyyymm", year_month(F.col(ts_ms)))
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("append").partitionBy("yyyymm").parquet(path)


def append_monthly(rows: DataFrame, path: str, batch_id: int, writer: str = "batch", ts_ms: str = "ts_ms") -> None:
    """One batch of a stream into the month table, its files in the order of ``write_monthly``; writing
    the same batch again replaces it. Batches of one ``writer`` (see ``upsert_batch``) never touch
    those of another. The range exchange looks at the rows twice: pass a batch that is persisted or a table."""
    order = ["yyyymm", *[c for c in ("card_id", ts_ms, "tx_id") if c in rows.columns]]
    ranged = rows.withColumn("yyyymm", year_month(F.col(ts_ms))).repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ranged.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("yyyymm", "writer", "batch_id")
        .parquet(path)
    )


def by_transaction(table: DataFrame, tx_id) -> DataFrame:
    return table.filter(F.col("tx_id") == F.lit(tx_id))


def by_card_and_time(table: DataFrame, card_id, from_ms: int, to_ms: int, ts_ms: str = "ts_ms") -> DataFrame:
    """Closed range; also prunes month partitions where the table has them."""
    found = table.filter((F.col("card_id") == F.lit(card_id)) & F.col(ts_ms).between(from_ms, to_ms))
    if "yyyymm" in table.columns:
        found = found.filter(F.col("yyyymm").between(year_month(F.lit(from_ms)), year_month(F.lit(to_ms))))
    return found


def retained(df: DataFrame, dataset: str, as_of: Column, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.expr(RETENTION[dataset]))


# --- dead letters -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Failure:
    topic: str
    group: str
    attempts: int = 3
    exception: str = "ValidationException"


def split_dead_letters(
    rows: DataFrame, errors: Column, failure: Failure, failed_ms: Column
) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the others as dead letters: payload text and failure columns."""
    payload = F.to_json(F.struct(*rows.columns))
    checked = rows.withColumn("_errors", errors)
    good = checked.filter(F.size("_errors") == 0).drop("_errors")
    dead = checked.filter(F.size("_errors") > 0).select(
        payload.alias("payload"),
        F.lit(failure.topic).alias("original_topic"),
        F.lit(failure.group).alias("consumer_group"),
        error_text(F.col("_errors")).alias("failure_reason"),
        F.lit(failure.attempts).alias("attempt_count"),
        failed_ms.alias("first_failure_ms"),
        failed_ms.alias("last_failure_ms"),
        F.lit(failure.exception).alias("exception_class"),
    )
    return good, dead


def replay_dead_letters(dead: DataFrame, schema, errors: Column) -> DataFrame:
    """Dead letters whose payload is valid now, with the topic they go back to."""
    rows = dead.select("original_topic", F.from_json("payload", schema).alias("_row")).select("original_topic", "_row.*")
    return rows.filter(F.size(errors) == 0)


def dead_again(dead: DataFrame, schema, errors: Column, failed_ms: Column) -> DataFrame:
    """Dead letters that fail once more: one attempt more, a new last failure and reason, the first
    failure kept."""
    row = F.from_json("payload", schema)
    checked = dead.withColumn("_row", row).select("*", "_row.*").withColumn("_errors", errors)
    return checked.filter(F.size("_errors") > 0).select(
        "payload",
        "original_topic",
        "consumer_group",
        error_text(F.col("_errors")).alias("failure_reason"),
        (F.col("attempt_count") + 1).alias("attempt_count"),
        "first_failure_ms",
        failed_ms.alias("last_failure_ms"),
        "exception_class",
    )


def write_back(replayed: DataFrame, sink_of: Callable[[str], Callable[[DataFrame], None]], topics: Sequence[str]) -> None:
    """Send replayed rows (see ``replay_dead_letters``) to the topic each one came from; ``topics`` is
    the fixed list of topics that have dead letters."""
    for topic in topics:
        sink_of(topic)(replayed.filter(F.col("original_topic") == topic).drop("original_topic"))


# --- reading by card and transaction ----------------------------------------------------------


def last_per_card(df: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` transactions of every card, ties by id. The limit is applied before the
    exchange as well."""
    order = Window.partitionBy("card_id").orderBy(F.desc("ts_ms"), "tx_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def timeline(
    events: DataFrame,
    types: Sequence[str] | None = None,
    from_ts: Column | None = None,
    to_ts: Column | None = None,
) -> DataFrame:
    """Events (tx_id, event_type, event_ts, ...) ascending by transaction, time and type."""
    if types is not None:
        events = events.filter(F.col("event_type").isin(list(types)))
    if from_ts is not None:
        events = events.filter(F.col("event_ts") >= from_ts)
    if to_ts is not None:
        events = events.filter(F.col("event_ts") <= to_ts)
    return events.orderBy("tx_id", "event_ts", "event_type")


def lifecycles(events: DataFrame, page_rows: int = 10_000, max_rows: int | None = skew.DEFAULT_MAX_ROWS) -> DataFrame:
    """One nested row per transaction: its events in order, and their number.

    A transaction with more than ``page_rows`` events gets several rows (``page`` 0, 1, ...), so that
    no array outgrows a task; ``event_count`` is the transaction's number of events on each of them.
    """
    order = ["event_ts", "event_type", "event_id"]

    def plain(rows: DataFrame) -> DataFrame:
        whole = Window.partitionBy("tx_id")
        return rows.withColumns({"_at": F.row_number().over(whole.orderBy(*order)).cast("long"), "_total": F.count(F.lit(1)).over(whole)})

    def sliced(rows: DataFrame) -> DataFrame:
        rows = skew.with_slice(rows, ["tx_id"], order)
        numbered = skew.sliced_running(rows, ["tx_id"], order, sums={"_at": F.lit(1).cast("long")}).drop("_slice")
        totals = rows.groupBy("tx_id").agg(F.count(F.lit(1)).alias("_total"))
        return skew.null_safe_join(numbered, totals, ["tx_id"])

    numbered = skew.by_heat(events, ["tx_id"], plain, sliced, max_rows)
    paged = numbered.withColumn("page", F.floor((F.col("_at") - 1) / F.lit(page_rows)).cast("int"))
    nested = F.array_sort(F.collect_list(F.struct("_at", "event_ts", "event_type", "event_id")))
    return (
        paged.groupBy("tx_id", "page")
        .agg(nested.alias("_events"), F.max("_total").alias("event_count"))
        .select(
            "tx_id",
            "page",
            F.transform("_events", lambda e: F.struct(e["event_ts"].alias("event_ts"), e["event_type"].alias("event_type"), e["event_id"].alias("event_id"))).alias("events"),
            "event_count",
        )
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("tx_id").agg(F.count(F.lit(1)).alias("event_count"))


# --- sets -------------------------------------------------------------------------------------


def union_topics(**topics: DataFrame) -> DataFrame:
    """Streams or tables of several topics as one, each row with its ``topic``."""
    parts = [df.withColumn("topic", F.lit(name)) for name, df in topics.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def drop_redelivered(df: DataFrame, key: str = "tx_id") -> DataFrame:
    return df.dropDuplicates([key])


def final_decisions(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decision log with challenge outcomes appended; the newest row of a transaction is final.

    Both need ``tx_id, decision, decision_ms``; at equal time the outcome wins.
    """
    both = decisions.withColumn("is_outcome", F.lit(0)).unionByName(
        outcomes.withColumn("is_outcome", F.lit(1)), allowMissingColumns=True
    )
    return latest_per_key(both, ["tx_id"], ["decision_ms", "is_outcome"])

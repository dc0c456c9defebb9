"""The streaming flows put together: enrichment, scoring, decline alerts, replies, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyguard.operators.analytics import DEFAULT_DECLINE_THRESHOLD, decline_spikes, spike_json
from tallyguard.operators.lookups import REPLY_TIMEOUT_MS
from tallyguard.operators.model import ModelVersions, feature_vector, onnx_probability
from tallyguard.operators.scoring import decision_rows, score_transactions
from tallyguard.streaming import sinks
from tallyguard.streaming.card_state import stream_card_features
from tallyguard.streaming.replies import stream_replies
from tallyguard.streaming.sources import DECISION_DELAY, with_event_time, without_redelivered


def enrich(transactions: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Watermark, drop redelivered copies, add the card features; ``states`` (see ``card_states``)
    stand for the transactions before the stream. Copies of those are not known to it."""
    return stream_card_features(without_redelivered(with_event_time(transactions)), states=states)


def decline_alerts(decisions: DataFrame, threshold: int = DEFAULT_DECLINE_THRESHOLD, keys=("merchant_id",)) -> DataFrame:
    """Alerts of closed five-minute windows; rows behind the watermark are dropped."""
    timed = with_event_time(decisions, "decision_ms", "decided_at", DECISION_DELAY)
    return decline_spikes(timed, threshold, keys)


def decline_alert_records(decisions: DataFrame, threshold: int = DEFAULT_DECLINE_THRESHOLD) -> DataFrame:
    return spike_json(decline_alerts(decisions, threshold))


def correlate_replies(requests: DataFrame, replies: DataFrame, timeout_ms: int = REPLY_TIMEOUT_MS, delay: str = "5 seconds") -> DataFrame:
    """Requests with the first reply that came in time, else marked as timed out; one row for each
    request, once the watermark has passed its deadline. ``requests``: tx_id, request_ms and more;
    ``replies``: tx_id, reply_ms and payload. Redelivered copies on either side change nothing."""
    return stream_replies(with_event_time(requests, "request_ms", "happened_at", delay), with_event_time(replies, "reply_ms", "happened_at", delay), timeout_ms)


def decisions_with_transactions(decisions: DataFrame, transactions: DataFrame, within: str = "1 minute") -> DataFrame:
    """Decisions with merchant, amount, country, channel and category of their transaction, which
    happened at most ``within`` before; where none came by the watermark they stay null. Copies on
    either side are dropped within the watermark delay, and the state on both sides is bounded by it."""
    filled = ["merchant_id", "amount", "country", "channel", "mcc"]
    left = with_event_time(decisions.drop(*filled), "decision_ms", "decided_at", DECISION_DELAY).dropDuplicatesWithinWatermark(["tx_id"])
    named = transactions.select(F.col("tx_id").alias("_of"), F.col("ts_ms").alias("_ms"), *filled)
    right = with_event_time(named, "_ms", "happened_at").dropDuplicatesWithinWatermark(["_of"])
    in_time = F.col("happened_at").between(F.col("decided_at") - F.expr(f"INTERVAL {within}"), F.col("decided_at"))
    return left.join(right, (F.col("tx_id") == F.col("_of")) & in_time, "leftOuter").drop("_of", "_ms", "decided_at", "happened_at")


def scoring_sink(sink: sinks.BatchSink, model_folder: str | None = None) -> sinks.BatchSink:
    """Score each micro-batch with the newest model of a folder (rules alone where there is none)."""
    models = ModelVersions(model_folder) if model_folder else None

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        model = models.current(spark) if models else None
        rows = batch.withColumn("p", onnx_probability(spark, model, feature_vector()))
        scored = score_transactions(rows, "p")
        sink(decision_rows(scored), batch_id)

    return write


@dataclass(frozen=True)
class AppPaths:
    enriched: str
    features: str
    alerts: str
    checkpoints: str


def start_app(
    spark: SparkSession, transactions: DataFrame, decisions: DataFrame, paths: AppPaths, available_now: bool = False
) -> list[StreamingQuery]:
    """Enrichment (to two sinks) and decline alerts as two queries of one session."""
    enrichment = sinks.start(
        enrich(transactions),
        sinks.each(sinks.table_sink(paths.enriched), sinks.table_sink(paths.features)),
        f"{paths.checkpoints}/enrichment",
        "transaction-enrichment",
        available_now=available_now,
    )
    alerts = sinks.append_files(
        decline_alert_records(decisions), paths.alerts, f"{paths.checkpoints}/alerts", "fraud-alerts", "json", available_now
    )
    return [enrichment, alerts]

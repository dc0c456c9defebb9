"""Streaming flows run over the given tables until all input is read; closed windows only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.operators import audit, scoring
from tallyguard.operators.authentication import session_states
from tallyguard.operators.card_windows import card_features
from tallyguard.operators.model import VECTOR_COLUMNS, ModelVersions, feature_vector, newest_model, onnx_probability, publish_model
from tallyguard.operators.onnx_logistic import logistic
from tallyguard.plans.audit_queries import decisions as decision_table
from tallyguard.plans.card_queries import _ALL, rules_text
from tallyguard.plans.oracle import DENSE, SPARSE, on_features, on_scores
from tallyguard.plans.registry import query
from tallyguard.plans.score_queries import _SESSIONS, sessions_and_results
from tallyguard.session import cut_lineage, fresh_path
from tallyguard.sources.views import DENSE_FACTOR, as_transactions, props_k, table, tx_dense, tx_sparse
from tallyguard.streaming import flows, sinks
from tallyguard.streaming.card_state import card_states
from tallyguard.streaming.sessions import stream_sessions
from tallyguard.streaming.sources import file_stream, with_event_time, without_redelivered


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream of transactions."""
    schema = table(spark, sf_dir, "events").schema
    raw = file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet*", schema)
    return as_transactions(raw, DENSE_FACTOR)


def as_stream(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it as a file stream."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return file_stream(df.sparkSession, path, df.schema)


def drain(stream: DataFrame, sink: Callable[[str], sinks.BatchSink], label: str) -> str:
    """Run a stream to the end of its input into a sink at a new path; returns the path."""
    spark = stream.sparkSession
    target = fresh_path(spark, label)
    running = sinks.start(stream, sink(target), fresh_path(spark, f"{label}-checkpoint"), label, available_now=True)
    running.awaitTermination()
    return target


FAR_MS = 4_000_000_000_000  # a row from far ahead moves the watermark past all others


def read(spark: SparkSession, path: str, *columns) -> DataFrame:
    return spark.read.parquet(path).select(*columns) if columns else spark.read.parquet(path).drop("writer", "batch_id")


@query("s01_transaction_stream", f"WITH {DENSE} SELECT tx_id, card_id, ts_ms, amount, merchant_id FROM tx")
def s01_transaction_stream(spark, sf_dir):
    rows = events_stream(spark, sf_dir).select("tx_id", "card_id", "ts_ms", "amount", "merchant_id")
    return read(spark, drain(rows, sinks.table_sink, "raw"))


@query("t05_stream_card_features", on_features(f"SELECT {_ALL} FROM feat"))
def t05_stream_card_features(spark, sf_dir):
    enriched = flows.enrich(events_stream(spark, sf_dir).drop("props", "event_type"))
    return read(spark, drain(enriched, sinks.table_sink, "enriched"), *_ALL.split(", "))


def _cuts(rows: DataFrame, shares: list[float]) -> list[int]:
    """Times that part the rows' stretch of time."""
    low, high = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return [int(low + (high - low) * share) for share in shares] if low is not None else [0 for _ in shares]


@query("s16_bootstrapped_features", on_features(f"SELECT {_ALL} FROM feat", SPARSE))
def s16_bootstrapped_features(spark, sf_dir):
    """The first half as a table, its state handed to a stream of the second half; the rows of both."""
    rows = tx_sparse(spark, sf_dir).drop("props", "event_type")
    (cut,) = _cuts(rows, [0.5])
    later = as_stream(rows.filter(F.col("ts_ms") >= cut), "second-half")
    enriched = flows.enrich(later, states=cut_lineage(card_states(rows, cut)))
    streamed = read(spark, drain(enriched, sinks.table_sink, "enriched"), *_ALL.split(", "))
    return card_features(rows.filter(F.col("ts_ms") < cut)).select(*_ALL.split(", ")).unionByName(streamed)


class SinkFailure(RuntimeError):
    """Raised by ``failing_sink``."""


def failing_sink(sink: sinks.BatchSink) -> sinks.BatchSink:
    """Writes about half of the micro-batch, then fails."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch.filter(F.col("tx_id") % 2 == 0), batch_id)
        raise SinkFailure(f"batch {batch_id}")

    return write


@query("t09_restarted_features", on_features(f"SELECT {_ALL} FROM feat", SPARSE))
def t09_restarted_features(spark, sf_dir):
    """The sink fails in the middle of the second micro-batch; a query started from the same
    checkpoint repeats that batch, and all rows come once, with features as if nothing had happened."""
    rows = tx_sparse(spark, sf_dir).drop("props", "event_type")
    first, second = _cuts(rows, [0.3, 0.6])
    source, target, checkpoint = [fresh_path(spark, label) for label in ("slices", "restarted", "restarted-checkpoint")]
    parts = [F.col("ts_ms") < first, (F.col("ts_ms") >= first) & (F.col("ts_ms") < second), F.col("ts_ms") >= second]

    def run(sink: sinks.BatchSink) -> None:
        enriched = flows.enrich(file_stream(spark, source, rows.schema))
        sinks.start(enriched, sink, checkpoint, f"restarted-{uuid.uuid4().hex}", available_now=True).awaitTermination()

    good = sinks.table_sink(target)
    for at, part in enumerate(parts):
        rows.filter(part).write.mode("append").parquet(source)
        if at == 1:
            try:
                run(failing_sink(good))
            except StreamingQueryException as stopped:
                if "SinkFailure" not in str(stopped):
                    raise
        run(good)
    return read(spark, target, *_ALL.split(", "))


# Weights of the trial models by input: sums are exact in 32 bits, so p depends on nothing but them.
_TRIAL = {"tx_count_1h": 0.25, "country_changed": 0.5}
_TRIAL_BIAS = -1.5
_TRIAL_P = "round(1/(1+exp(-({sign}*(0.25*tx_count_1h+0.5*CAST(country_changed AS INTEGER)-1.5)))),4)"


def _trial_model(sign: float) -> bytes:
    return logistic([sign * _TRIAL.get(name, 0.0) for name in VECTOR_COLUMNS], sign * _TRIAL_BIAS)


@query("r13_onnx_probability", on_features(f"SELECT tx_id, {_TRIAL_P.format(sign=1)} AS p FROM feat"))
def r13_onnx_probability(spark, sf_dir):
    """A logistic model as an ONNX file, applied to the feature vectors of all transactions."""
    folder = fresh_path(spark, "models")
    publish_model(spark, folder, "a", _trial_model(1.0))
    rows = card_features(tx_dense(spark, sf_dir))
    return rows.select("tx_id", F.round(onnx_probability(spark, newest_model(spark, folder), feature_vector()), 4).alias("p"))


@query(
    "r15_model_swap",
    on_features(
        f"""SELECT tx_id, CASE WHEN ts_ms<lo+(hi-lo)*0.5 THEN {_TRIAL_P.format(sign=1)} ELSE {_TRIAL_P.format(sign=-1)} END AS p
        FROM feat JOIN (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM tx) ON true"""
    ),
)
def r15_model_swap(spark, sf_dir):
    """A second model is published between two micro-batches of a running sink."""
    rows = card_features(tx_dense(spark, sf_dir))
    (cut,) = _cuts(tx_dense(spark, sf_dir), [0.5])
    folder, source, target, checkpoint = [fresh_path(spark, label) for label in ("models", "slices", "scored", "scored-checkpoint")]
    models, write = ModelVersions(folder), sinks.table_sink(target)

    def score(batch: DataFrame, batch_id: int) -> None:
        p = onnx_probability(batch.sparkSession, models.current(batch.sparkSession), feature_vector())
        write(batch.select("tx_id", F.round(p, 4).alias("p")), batch_id)

    for name, sign, part in (("a", 1.0, F.col("ts_ms") < cut), ("b", -1.0, F.col("ts_ms") >= cut)):
        publish_model(spark, folder, name, _trial_model(sign))
        rows.filter(part).write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows.schema)
        sinks.start(stream, score, checkpoint, f"swapped-{uuid.uuid4().hex}", available_now=True).awaitTermination()
    return read(spark, target)


@query("t07_stream_scoring", on_scores("SELECT tx_id, card_id, merchant_id, risk_score, decision, applied_rules, ts_ms AS decision_ms FROM scored"))
def t07_stream_scoring(spark, sf_dir):
    enriched = flows.enrich(events_stream(spark, sf_dir).drop("props", "event_type"))
    target = drain(enriched, lambda path: flows.scoring_sink(sinks.table_sink(path)), "decisions")
    return read(spark, target, "tx_id", "card_id", "merchant_id", "risk_score", "decision", rules_text(), "decision_ms")


@query(
    "t03_stream_decline_alerts",
    on_scores(
        """SELECT merchant_id%4 AS merchant_id, ts_ms//300000*300000 AS window_start_ms, ts_ms//300000*300000+300000 AS window_end_ms,
          count(*) AS total_count, count(*) FILTER (WHERE decision='DECLINE') AS decline_count, 2 AS threshold FROM scored
        GROUP BY 1,2,3 HAVING decline_count>2""",
        with_p=True,
    ),
)
def t03_stream_decline_alerts(spark, sf_dir):
    rows = decision_table(spark, sf_dir).select(F.pmod("merchant_id", F.lit(4)).alias("merchant_id"), "decision", "decision_ms")
    rows = rows.union(rows.limit(1).withColumn("decision_ms", F.lit(FAR_MS)))
    alerts = flows.decline_alerts(as_stream(rows, "decisions-in"), threshold=2)
    return read(spark, drain(alerts, sinks.table_sink, "alerts"))


@query(
    "j03_stream_reply_in_time",
    f"""WITH {DENSE} SELECT tx_id, k>45 AS timed_out, CASE WHEN k<=45 THEN ts_ms+k END AS reply_ms FROM tx""",
)
def j03_stream_reply_in_time(spark, sf_dir):
    rows = tx_dense(spark, sf_dir).withColumn("k", props_k())
    return _correlated(spark, rows, rows.select("tx_id", (F.col("ts_ms") + F.col("k")).alias("reply_ms")))


def _correlated(spark: SparkSession, asked: DataFrame, came: DataFrame) -> DataFrame:
    """Requests and replies as streams, each with a row from far ahead that closes all others."""
    far = asked.limit(1).select(F.lit(-1).cast("long").alias("tx_id"), F.lit(FAR_MS).alias("ms"))
    requests = asked.select("tx_id", F.col("ts_ms").alias("request_ms")).union(far)
    joined = flows.correlate_replies(as_stream(requests, "requests"), as_stream(came.union(far), "replies"))
    return read(spark, drain(joined.select("tx_id", "timed_out", "reply_ms"), sinks.table_sink, "correlated")).filter("tx_id >= 0")


@query(
    "j02_stream_decision_with_transaction",
    f"""WITH {DENSE} SELECT tx_id, ts_ms + k AS decision_ms, CASE WHEN tx_id%5<>0 THEN merchant_id END AS merchant_id,
      CASE WHEN tx_id%5<>0 THEN amount END AS amount, CASE WHEN tx_id%5<>0 THEN channel END AS channel FROM tx""",
)
def j02_stream_decision_with_transaction(spark, sf_dir):
    """Every fifth decision's transaction comes under another id; all transactions come twice."""
    rows = tx_dense(spark, sf_dir).withColumn("k", props_k())
    far = rows.limit(1).withColumns({"tx_id": F.lit(-1).cast("long"), "ts_ms": F.lit(FAR_MS)})
    decided = rows.unionByName(far).select("tx_id", (F.col("ts_ms") + F.col("k")).alias("decision_ms"))
    own = F.when(F.col("tx_id") % 5 == 0, -2 - F.col("tx_id")).otherwise(F.col("tx_id"))
    happened = rows.unionByName(far).select(own.alias("tx_id"), "ts_ms", "merchant_id", "amount", "country", "channel", "mcc")
    joined = flows.decisions_with_transactions(as_stream(decided, "decisions-in"), as_stream(happened.unionByName(happened), "transactions-in"))
    filled = drain(joined.select("tx_id", "decision_ms", "merchant_id", "amount", "channel"), sinks.table_sink, "filled")
    return read(spark, filled).filter("tx_id >= 0")


@query(
    "s09_stream_month_table",
    f"WITH {SPARSE} SELECT tx_id, ts_ms, CAST(strftime(make_timestamp(ts_ms*1000), '%Y%m') AS INTEGER) AS yyyymm FROM tx",
)
def s09_stream_month_table(spark, sf_dir):
    """A stream of transactions into the month table."""
    rows = as_stream(tx_sparse(spark, sf_dir).select("tx_id", "ts_ms"), "transactions-in")
    return read(spark, drain(rows, sinks.month_sink, "months")).select("tx_id", "ts_ms", "yyyymm")


@query(
    "j03_stream_redelivered",
    f"""WITH {DENSE} SELECT tx_id, k>45 AS timed_out, CASE WHEN k<=45 THEN ts_ms+k END AS reply_ms FROM tx""",
)
def j03_stream_redelivered(spark, sf_dir):
    """Every request and every reply is sent twice."""
    rows = tx_dense(spark, sf_dir).withColumn("k", props_k())
    rows = rows.unionByName(rows)
    return _correlated(spark, rows, rows.select("tx_id", (F.col("ts_ms") + F.col("k")).alias("reply_ms")))


@query(
    "j03_stream_two_replies",
    f"""WITH {DENSE}, replies AS (
      SELECT tx_id, ts_ms, ts_ms + k AS reply_ms FROM tx UNION ALL SELECT tx_id, ts_ms, ts_ms + k // 2 + 3 FROM tx UNION ALL SELECT tx_id, ts_ms, ts_ms + 46 FROM tx
    ) SELECT t.tx_id, count(r.reply_ms) = 0 AS timed_out, min(r.reply_ms) AS reply_ms
    FROM tx t LEFT JOIN replies r ON r.tx_id = t.tx_id AND r.reply_ms BETWEEN t.ts_ms AND t.ts_ms + 45 GROUP BY t.tx_id""",
)
def j03_stream_two_replies(spark, sf_dir):
    """Three replies for each request, the last just too late; the earliest in time counts. Every
    third reply comes twice."""
    rows = tx_dense(spark, sf_dir).withColumn("k", props_k())
    came = [rows.select("tx_id", (F.col("ts_ms") + after).alias("reply_ms")) for after in (F.col("k"), F.expr("k div 2 + 3"), F.lit(46))]
    return _correlated(spark, rows, came[0].union(came[1]).union(came[2]).union(came[0].filter("tx_id % 3 = 0")))


@query(
    "t10_second_result",
    on_scores("SELECT trans_id, CASE WHEN trans_id%2=0 THEN 'COMPLETED' ELSE 'FAILED' END AS state FROM sessions", more=_SESSIONS),
)
def t10_second_result(spark, sf_dir):
    """Every session gets two results; the later one by its time stands, whatever their order."""
    sessions, _ = sessions_and_results(spark, sf_dir)
    even = F.col("trans_id") % 2 == 0
    first = sessions.select("trans_id", F.when(even, "N").otherwise("Y").alias("result_status"), F.lit(1).alias("result_ms"))
    second = sessions.select("trans_id", F.when(even, "Y").otherwise("N").alias("result_status"), F.lit(2).alias("result_ms"))
    return session_states(sessions, second.unionByName(first)).select("trans_id", "state")


@query(
    "t10_stream_sessions",
    on_scores(
        """SELECT CAST(trans_id AS VARCHAR) AS trans_id, 'PENDING' AS state, NULL::VARCHAR AS trans_status, NULL::VARCHAR AS eci FROM sessions
        UNION ALL SELECT CAST(trans_id AS VARCHAR), CASE WHEN ok THEN 'COMPLETED' ELSE 'FAILED' END, CASE WHEN ok THEN 'Y' ELSE 'N' END,
          CASE WHEN NOT ok THEN '07' WHEN risk_score%2=0 THEN '05' ELSE '02' END FROM done
        UNION ALL SELECT CAST(trans_id AS VARCHAR), 'NOT_FOUND', NULL, NULL FROM results WHERE trans_id NOT IN (SELECT trans_id FROM sessions)""",
        more=_SESSIONS,
    ),
)
def t10_stream_sessions(spark, sf_dir):
    sessions, results = sessions_and_results(spark, sf_dir)
    changes = stream_sessions(as_stream(sessions, "sessions"), as_stream(results, "results"))
    return read(spark, drain(changes, sinks.table_sink, "session-states"))


@query(
    "t10_results_over_batches",
    on_scores("SELECT CAST(trans_id AS VARCHAR) AS trans_id, list_sort(['PENDING', CASE WHEN trans_id%2=0 THEN 'COMPLETED' ELSE 'FAILED' END]) AS states FROM sessions", more=_SESSIONS),
)
def t10_results_over_batches(spark, sf_dir):
    """The later result of each session comes one micro-batch before the older one."""
    sessions, _ = sessions_and_results(spark, sf_dir)
    sessions = sessions.dropDuplicates(["trans_id"])
    even = F.col("trans_id") % 2 == 0
    opened = as_stream(sessions, "sessions")
    source, target, checkpoint = [fresh_path(spark, label) for label in ("results", "session-states", "session-states-checkpoint")]
    for ms, ok, bad in ((2, "Y", "N"), (1, "N", "Y")):
        results = sessions.select("trans_id", F.when(even, ok).otherwise(bad).alias("result_status"), F.lit(ms).cast("long").alias("result_ms"))
        results.write.mode("append").parquet(source)
        # What is there is one micro-batch, in as many files as the tasks write.
        changes = stream_sessions(opened, file_stream(spark, source, results.schema))
        sinks.start(changes, sinks.table_sink(target), checkpoint, f"results-{uuid.uuid4().hex}", available_now=True).awaitTermination()
    told = read(spark, target)
    return told.groupBy("trans_id").agg(F.array_sort(F.collect_list("state")).alias("states"))


@query(
    "s07_reply_route",
    on_scores(
        """SELECT 'replies-' || card_id%3 AS topic, tx_id, decision FROM scored WHERE tx_id%2=0
        UNION ALL SELECT 'fraud.decisions', tx_id, decision FROM scored""",
        with_p=True,
    ),
)
def s07_reply_route(spark, sf_dir):
    """Every second request asks for a reply."""
    topic = F.when(F.col("tx_id") % 2 == 0, F.concat(F.lit("replies-"), (F.col("card_id") % 3).cast("string")))
    rows = decision_table(spark, sf_dir).select("tx_id", "card_id", "decision", topic.alias("reply_topic"))

    def route(path: str) -> sinks.BatchSink:
        return sinks.decisions_with_reply(sinks.table_sink(f"{path}/decisions"), sinks.table_sink(f"{path}/replies"))

    target = drain(as_stream(rows, "decisions-in"), route, "routed")
    everything = spark.read.parquet(f"{target}/decisions").withColumn("topic", F.lit("fraud.decisions"))
    replies = spark.read.parquet(f"{target}/replies")
    return everything.select("topic", "tx_id", "decision").unionByName(replies.select("topic", "tx_id", "decision"))


@query(
    "s09_stream_audit_and_analytics",
    on_scores(
        """SELECT a.tx_id, a.decision, a.risk_score, '' AS country FROM scored a""",
        with_p=True,
    ),
)
def s09_stream_audit_and_analytics(spark, sf_dir):
    """Decisions, each delivered twice, to the audit and analytics tables."""
    rows = decision_table(spark, sf_dir)
    twice = as_stream(rows.unionByName(rows), "decisions-in")
    target = drain(twice, lambda path: sinks.audit_sink(f"{path}/audit", f"{path}/analytics"), "audited")
    kept = audit.current_rows(spark, f"{target}/audit", columns=["decision", "risk_score"])
    return kept.join(audit.current_rows(spark, f"{target}/analytics", columns=["country"]), "tx_id")


@query("s02_decision_stream", on_scores("SELECT tx_id, merchant_id, decision, risk_score, ts_ms AS decision_ms FROM scored", with_p=True))
def s02_decision_stream(spark, sf_dir):
    rows = decision_table(spark, sf_dir).select("tx_id", "merchant_id", "decision", "risk_score", "decision_ms")
    return read(spark, drain(as_stream(rows, "decisions-in"), sinks.table_sink, "decisions-read"))


@query("s03_enriched_sink", on_features("SELECT tx_id, card_id, tx_count_1h, avg_amount_7d, velocity_score FROM feat"))
def s03_enriched_sink(spark, sf_dir):
    """Enriched rows through Spark's own exactly-once file sink."""
    target = fresh_path(spark, "enriched")
    enriched = flows.enrich(events_stream(spark, sf_dir).drop("props", "event_type"))
    sinks.append_files(enriched, target, fresh_path(spark, "checkpoint"), "enriched-sink", available_now=True).awaitTermination()
    return spark.read.parquet(target).select("tx_id", "card_id", "tx_count_1h", "avg_amount_7d", "velocity_score")


@query(
    "s04_two_sinks",
    f"""WITH {DENSE} SELECT 'enriched' AS sink, tx_id, card_id FROM tx UNION ALL SELECT 'updates', tx_id, card_id FROM tx""",
)
def s04_two_sinks(spark, sf_dir):
    """One stream, evaluated once per micro-batch, to two sinks."""

    def both(path: str) -> sinks.BatchSink:
        return sinks.each(sinks.table_sink(f"{path}/enriched"), sinks.table_sink(f"{path}/updates"))

    target = drain(events_stream(spark, sf_dir).select("tx_id", "card_id"), both, "fan-out")
    parts = [spark.read.parquet(f"{target}/{sink}").select(F.lit(sink).alias("sink"), "tx_id", "card_id") for sink in ("enriched", "updates")]
    return parts[0].unionByName(parts[1])


@query(
    "s06_two_topics",
    on_scores(
        """SELECT 'fraud.decisions' AS topic, tx_id, decision, NULL::VARCHAR AS reason FROM scored
        UNION ALL SELECT 'fraud.alerts', tx_id, NULL, 'CRITICAL' FROM scored WHERE risk_band='CRITICAL'""",
        with_p=True,
    ),
)
def s06_two_topics(spark, sf_dir):
    """Decision and alert streams consumed as one."""
    rows = decision_table(spark, sf_dir)
    critical = rows.filter(scoring.risk_band(F.col("risk_score")) == "CRITICAL").select("tx_id", F.lit("CRITICAL").alias("reason"))
    merged = audit.union_topics(
        **{"fraud.decisions": as_stream(rows.select("tx_id", "decision"), "topic-a"), "fraud.alerts": as_stream(critical, "topic-b")}
    )
    return read(spark, drain(merged, sinks.table_sink, "topics"), "topic", "tx_id", "decision", "reason")


@query("u02_stream_redelivered_once", f"WITH {DENSE} SELECT tx_id, card_id, ts_ms FROM tx")
def u02_stream_redelivered_once(spark, sf_dir):
    rows = tx_dense(spark, sf_dir).select("tx_id", "card_id", "ts_ms")
    sent = as_stream(rows.unionByName(rows).unionByName(rows.filter(F.col("tx_id") % 3 == 0)), "redelivered")
    once = without_redelivered(with_event_time(sent)).drop("event_time")
    return read(spark, drain(once, sinks.table_sink, "once"))

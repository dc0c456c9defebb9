"""Request validation, audit trail, replay, dead letters, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions import requests, text
from tallyguard.operators import audit, lookups, scoring
from tallyguard.plans.card_queries import dense_scores, rules_text
from tallyguard.plans.oracle import DENSE, SPARSE, on_scores
from tallyguard.plans.registry import query
from tallyguard.session import fresh_path
from tallyguard.sources.views import EPOCH_2024_MS, table, tx_dense, tx_sparse

# --- requests derived from the orders table (the same column texts in both engines) ------------

_REQUEST = {
    "request_id": "o_orderkey",
    "card_id": "CASE WHEN o_orderkey%11=0 THEN '  ' ELSE CAST(o_custkey AS {string}) END",
    "merchant_id": "CASE WHEN o_orderkey%13=0 THEN NULL ELSE concat('m', CAST(o_orderkey%40 AS {string})) END",
    "amount": "CAST(CASE WHEN o_orderkey%17=0 THEN NULL WHEN o_orderkey%19=0 THEN -o_totalprice WHEN o_orderkey%23=0 THEN 0 "
    "WHEN o_orderkey%26=1 THEN 0.005 ELSE o_totalprice END AS DECIMAL(18,4))",
    "currency": "CASE WHEN o_orderkey%7=0 THEN 'US' WHEN o_orderkey%29=0 THEN '' WHEN o_orderkey%31=0 THEN NULL ELSE 'USD' END",
    "mcc": "CASE WHEN o_orderkey%37=0 THEN '' ELSE '5411' END",
    "channel": "CASE WHEN o_orderkey%47=0 THEN ' ' WHEN o_orderkey%4=0 THEN 'pos' WHEN o_orderkey%4=1 THEN 'ATM' "
    "WHEN o_orderkey%4=2 THEN 'Ecom' ELSE 'kiosk' END",
    "latitude": "CASE WHEN o_orderkey%2=0 THEN CAST(o_orderkey%90 AS DOUBLE) END",
    "longitude": "CASE WHEN o_orderkey%3=0 THEN CAST(o_orderkey%180 AS DOUBLE) END",
    "country": "CASE WHEN o_orderkey%41=0 THEN 'GBR' WHEN o_orderkey%43=0 THEN NULL ELSE 'US' END",
    "device_fingerprint": "CASE WHEN o_orderkey%3<>0 THEN concat('dev', CAST(o_orderkey%5 AS {string})) END",
    "message_version": "CASE WHEN o_orderkey%3=0 THEN NULL WHEN o_orderkey%3=1 THEN ' ' ELSE '2.1.0' END",
    "received_ms": f"{EPOCH_2024_MS} + o_orderkey",
}


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        *[f"{sql.format(string='STRING')} AS {name}" for name, sql in _REQUEST.items()]
    )


_REQUESTS = "req AS (SELECT " + ", ".join(f"{sql.format(string='VARCHAR')} AS {name}" for name, sql in _REQUEST.items()) + " FROM orders)"

# Messages in their sorted order.
_ERRORS = """nullif(concat_ws('; ',
  CASE WHEN amount<=0 THEN 'amount must be positive' END,
  CASE WHEN amount IS NULL THEN 'amount must not be null' END,
  CASE WHEN card_id IS NULL OR trim(card_id)='' THEN 'cardId must not be blank' END,
  CASE WHEN channel IS NULL OR trim(channel)='' THEN 'channel must not be blank' END,
  CASE WHEN length(country)<>2 THEN 'country must be a 2-letter ISO code' END,
  CASE WHEN country IS NULL OR trim(country)='' THEN 'country must not be blank' END,
  CASE WHEN length(currency)<>3 THEN 'currency must be a 3-letter ISO code' END,
  CASE WHEN currency IS NULL OR trim(currency)='' THEN 'currency must not be blank' END,
  CASE WHEN mcc IS NULL OR trim(mcc)='' THEN 'mcc must not be blank' END,
  CASE WHEN merchant_id IS NULL OR trim(merchant_id)='' THEN 'merchantId must not be blank' END), '')"""

_AUTH_ERRORS = """nullif(concat_ws('; ',
  CASE WHEN amount IS NULL THEN 'amount is required' END,
  CASE WHEN amount<0.01 THEN 'amount must be greater than 0' END,
  CASE WHEN card_id IS NULL OR trim(card_id)='' THEN 'cardId is required' END,
  CASE WHEN currency IS NULL OR trim(currency)='' THEN 'currency is required' END,
  CASE WHEN length(currency)<>3 THEN 'currency must be a 3-letter ISO 4217 code' END,
  CASE WHEN merchant_id IS NULL OR trim(merchant_id)='' THEN 'merchantId is required' END), '')"""

_CHECKED = f"{_REQUESTS}, checked AS (SELECT *, {_ERRORS} AS errors, {_AUTH_ERRORS} AS auth_errors FROM req)"


@query(
    "p01_request_checks",
    f"WITH {_CHECKED} SELECT request_id, errors IS NULL AS valid, CASE WHEN errors IS NULL THEN 0 ELSE len(string_split(errors,'; ')) END AS error_count FROM checked",
)
def p01_request_checks(spark, sf_dir):
    errors = requests.transaction_errors()
    return request_rows(spark, sf_dir).select(
        "request_id", (F.size(errors) == 0).alias("valid"), F.size(errors).alias("error_count")
    )


@query("p02_error_text", f"WITH {_CHECKED} SELECT request_id, coalesce(errors,'') AS errors FROM checked")
def p02_error_text(spark, sf_dir):
    return request_rows(spark, sf_dir).select(
        "request_id", requests.error_text(requests.transaction_errors()).alias("errors")
    )


@query(
    "p03_authentication_checks",
    f"""WITH {_CHECKED} SELECT request_id, coalesce(auth_errors,'') AS errors,
      CASE WHEN message_version IS NULL OR trim(message_version)='' THEN '2.2.0' ELSE message_version END AS message_version FROM checked""",
)
def p03_authentication_checks(spark, sf_dir):
    return request_rows(spark, sf_dir).select(
        "request_id",
        requests.error_text(requests.authentication_errors()).alias("errors"),
        requests.message_version(F.col("message_version")).alias("message_version"),
    )


@query(
    "p04_challenge_checks",
    f"""WITH {_REQUESTS} SELECT request_id, concat_ws('; ',
      CASE WHEN card_id IS NULL OR trim(card_id)='' THEN 'threeDSServerTransID is required' END,
      CASE WHEN currency IS NULL OR trim(currency)='' THEN 'transStatus is required' END) AS errors FROM req""",
)
def p04_challenge_checks(spark, sf_dir):
    results = request_rows(spark, sf_dir).withColumnsRenamed({"card_id": "trans_id", "currency": "trans_status"})
    return results.select("request_id", requests.error_text(requests.challenge_errors()).alias("errors"))


@query(
    "p05_request_to_event",
    f"""WITH {_CHECKED} SELECT request_id AS tx_id, card_id, merchant_id, CAST(amount AS DOUBLE) AS amount, currency, mcc,
      CASE WHEN upper(channel) IN ('POS','ECOM','ATM') THEN upper(channel) ELSE 'ECOM' END AS channel,
      coalesce(latitude,0.0::DOUBLE) AS lat, coalesce(longitude,0.0::DOUBLE) AS lon, country, device_fingerprint, received_ms AS ts_ms
    FROM checked WHERE errors IS NULL""",
)
def p05_request_to_event(spark, sf_dir):
    valid = request_rows(spark, sf_dir).filter(F.size(requests.transaction_errors()) == 0)
    events = requests.request_to_event(valid, F.col("request_id"), F.col("received_ms"))
    return events.select("*", "location.*").drop("location")


_TIME_PART = " || ".join(f"substr('{text.CROCKFORD}', CAST((ts_ms >> {shift}) & 31 AS INTEGER) + 1, 1)" for shift in range(45, -1, -5))


@query("p06_sortable_ids", f"WITH {DENSE} SELECT tx_id, ts_ms, 26 AS id_length, {_TIME_PART} AS time_part FROM tx")
def p06_sortable_ids(spark, sf_dir):
    rows = tx_dense(spark, sf_dir).select("tx_id", "ts_ms", text.sortable_id(F.col("ts_ms")).alias("ulid"))
    return rows.select("tx_id", "ts_ms", F.length("ulid").alias("id_length"), F.substring("ulid", 1, 10).alias("time_part"))


# --- decision rows and their projections --------------------------------------------------------


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decision_rows(dense_scores(spark, sf_dir, with_p=True))


@query("p07_response", on_scores("SELECT tx_id, risk_score, decision, CASE WHEN tx_id%6=0 THEN '' ELSE applied_rules END AS applied_rules, 0::BIGINT AS latency_ms FROM scored", with_p=True))
def p07_response(spark, sf_dir):
    """Every sixth decision arrives without a rule list."""
    rows = decisions(spark, sf_dir).withColumn("applied_rules", F.when(F.col("tx_id") % 6 != 0, F.col("applied_rules")))
    return requests.decision_to_response(rows).withColumn("applied_rules", rules_text())


_HASH_FIELDS = {
    "tx_count_1h": "CASE WHEN event_id%7=0 THEN 'many' ELSE CAST(user_id AS {string}) END",
    "avg_amount_7d": "CASE WHEN event_id%5=0 THEN '' ELSE CAST(CAST(value*100 AS INT)/100.0 AS {string}) END",
    "last_country": "CASE WHEN event_id%4=0 THEN '' WHEN event_id%4=1 THEN NULL ELSE 'US' END",
    "country_changed": "CASE WHEN event_id%3=0 THEN '1' WHEN event_id%3=1 THEN 'TRUE' ELSE '0' END",
    "time_since_last_tx_ms": "CASE WHEN event_id%6=0 THEN NULL ELSE CAST(event_id*1000 AS {string}) END",
    "device_hash": "CASE WHEN event_id%2=0 THEN 'abc123' ELSE '' END",
}


@query(
    "p08_typed_snapshot",
    """SELECT event_id AS card_id, CAST(CASE WHEN event_id%7=0 THEN 0 ELSE user_id END AS INTEGER) AS tx_count_1h, 0 AS tx_count_6h,
      CASE WHEN event_id%5=0 THEN 0.0::DOUBLE ELSE value END AS avg_amount_7d,
      CASE WHEN event_id%4>1 THEN 'US' END AS last_country, event_id%3<2 AS country_changed,
      CASE WHEN event_id%6=0 THEN -1 ELSE event_id*1000 END AS time_since_last_tx_ms,
      CASE WHEN event_id%2=0 THEN 'abc123' END AS device_hash, 0.0::DOUBLE AS velocity_score FROM events""",
)
def p08_typed_snapshot(spark, sf_dir):
    """Feature hashes with missing, blank and unreadable fields."""
    fields = {**_HASH_FIELDS, "avg_amount_7d": "CASE WHEN event_id%5=0 THEN 'n/a' ELSE CAST(value AS {string}) END"}
    pairs = ", ".join(f"'{name}', {sql.format(string='STRING')}" for name, sql in fields.items())
    hashes = table(spark, sf_dir, "events").selectExpr("event_id AS card_id", f"map({pairs}) AS fields")
    return requests.typed_snapshot(hashes).select(
        "card_id", "tx_count_1h", "tx_count_6h", "avg_amount_7d", "last_country", "country_changed", "time_since_last_tx_ms",
        "device_hash", "velocity_score",
    )


@query(
    "p09_audit_rows",
    on_scores(
        """SELECT tx_id, card_id, '' AS merchant_id, 0.0::DOUBLE AS amount, risk_score, decision, applied_rules, 0::BIGINT AS latency_ms,
          ts_ms AS at_ms, tx_id AS raw_tx, decision AS raw_decision FROM scored""",
        with_p=True,
    ),
)
def p09_audit_rows(spark, sf_dir):
    rows = audit.audit_rows(decisions(spark, sf_dir))
    return rows.select(
        "tx_id", "card_id", "merchant_id", F.col("amount").cast("double").alias("amount"), "risk_score", "decision", rules_text(),
        "latency_ms", F.unix_millis("ts").alias("at_ms"),
        F.get_json_object("raw_event", "$.tx_id").cast("long").alias("raw_tx"),
        F.get_json_object("raw_event", "$.decision").alias("raw_decision"),
    )


@query(
    "p10_analytics_rows",
    on_scores(
        """SELECT tx_id, card_id, '' AS merchant_id, 0.0::DOUBLE AS amount, risk_score, decision, 0::BIGINT AS latency_ms, ts_ms AS at_ms,
          '' AS country, '' AS channel, '' AS mcc FROM scored""",
        with_p=True,
    ),
)
def p10_analytics_rows(spark, sf_dir):
    rows = audit.analytics_rows(audit.audit_rows(decisions(spark, sf_dir)))
    return rows.withColumn("at_ms", F.unix_millis("ts")).drop("ts")


@query(
    "j02_decision_with_transaction",
    on_scores("SELECT tx_id, card_id, risk_score, decision, merchant_id, amount, country, channel, mcc FROM scored", with_p=True),
)
def j02_decision_with_transaction(spark, sf_dir):
    joined = lookups.decisions_with_transactions(decisions(spark, sf_dir), tx_dense(spark, sf_dir))
    return joined.select("tx_id", "card_id", "risk_score", "decision", "merchant_id", "amount", "country", "channel", "mcc")


# Replayed range: hours 2 to 5 of the dense view.
_FROM_MS, _TO_MS = EPOCH_2024_MS + 2 * 3_600_000, EPOCH_2024_MS + 5 * 3_600_000


def _odd_decisions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("decision", F.when(F.col("tx_id") % 9 == 0, "REVIEW").otherwise(F.col("decision")))


_REPLAYED = f"""SELECT tx_id, card_id, risk_score, CASE WHEN tx_id%9=0 THEN 'APPROVE' ELSE decision END AS decision, applied_rules,
  0::BIGINT AS latency_ms, ts_ms AS decision_ms FROM scored WHERE ts_ms BETWEEN {_FROM_MS} AND {_TO_MS}"""


@query("p11_replay_events", on_scores(_REPLAYED, with_p=True))
def p11_replay_events(spark, sf_dir):
    rows = audit.audit_rows(_odd_decisions(decisions(spark, sf_dir)))
    events = audit.replay_events(rows, F.timestamp_millis(F.lit(_FROM_MS)), F.timestamp_millis(F.lit(_TO_MS)))
    return events.withColumn("applied_rules", rules_text()).drop("model_scores")


@query("s14_replay_job", on_scores(_REPLAYED, with_p=True))
def s14_replay_job(spark, sf_dir):
    """The replay written to a sink and read back."""
    rows = audit.audit_rows(_odd_decisions(decisions(spark, sf_dir)))
    target = fresh_path(spark, "replay")
    audit.replay(rows, F.timestamp_millis(F.lit(_FROM_MS)), F.timestamp_millis(F.lit(_TO_MS)), target)
    return spark.read.parquet(target).withColumn("applied_rules", rules_text()).drop("model_scores")


@query(
    "s08_audit_upsert",
    on_scores(
        """SELECT tx_id, CASE WHEN tx_id%5=0 THEN 999 ELSE risk_score END AS risk_score,
          CASE WHEN tx_id%5=0 THEN 'DECLINE' ELSE decision END AS decision FROM scored""",
        with_p=True,
    ),
)
def s08_audit_upsert(spark, sf_dir):
    """A second batch, itself delivered twice, replaces every fifth row."""
    rows = decisions(spark, sf_dir).select("tx_id", "risk_score", "decision")
    path = fresh_path(spark, "audit")
    audit.upsert_batch(rows, path, 0)
    again = rows.filter(F.col("tx_id") % 5 == 0).withColumns({"risk_score": F.lit(999), "decision": F.lit("DECLINE")})
    audit.upsert_batch(again.unionByName(again), path, 1)
    audit.upsert_batch(again.unionByName(again), path, 1)
    return audit.current_rows(spark, path)


_AFTER = """SELECT tx_id, CASE WHEN tx_id%5=0 THEN 999 ELSE risk_score END AS risk_score,
  CASE WHEN tx_id%5=0 THEN 'DECLINE' ELSE decision END AS decision FROM scored"""


@query("s08_fresh_checkpoint_keeps_history", on_scores(_AFTER, with_p=True))
def s08_fresh_checkpoint_keeps_history(spark, sf_dir):
    """The table is compacted; a stream with a new checkpoint then begins at batch 0 again."""
    rows = decisions(spark, sf_dir).select("tx_id", "risk_score", "decision")
    path, folded = fresh_path(spark, "audit"), fresh_path(spark, "audit")
    audit.upsert_batch(rows, path, 0, "first")
    audit.compact(spark, path, folded)
    late = rows.filter(F.col("tx_id") % 5 == 0).withColumns({"risk_score": F.lit(999), "decision": F.lit("DECLINE")})
    audit.upsert_batch(late, folded, 0, "second")
    return audit.current_rows(spark, folded)


@query("s08_two_states_in_one_batch", on_scores(_AFTER, with_p=True))
def s08_two_states_in_one_batch(spark, sf_dir):
    """Both states of a transaction come in one batch, in no order: the later one by event time stays."""
    rows = decisions(spark, sf_dir).select("tx_id", "risk_score", "decision", F.lit(1).alias("ts"))
    late = rows.filter(F.col("tx_id") % 5 == 0).withColumns({"risk_score": F.lit(999), "decision": F.lit("DECLINE"), "ts": F.lit(2)})
    path = fresh_path(spark, "audit")
    audit.upsert_batch(late.unionByName(rows), path, 0)
    return audit.current_rows(spark, path).drop("ts")


@query(
    "s10_month_table",
    f"""WITH {SPARSE} SELECT tx_id, card_id, ts_ms, amount, CAST(strftime(make_timestamp(ts_ms*1000), '%Y%m') AS INTEGER) AS yyyymm FROM tx""",
)
def s10_month_table(spark, sf_dir):
    path = fresh_path(spark, "monthly")
    audit.write_monthly(tx_sparse(spark, sf_dir).select("tx_id", "card_id", "ts_ms", "amount"), path)
    return spark.read.parquet(path)


def _lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table of all decisions, every fifth one revised, in its layout for lookups."""
    rows = decisions(spark, sf_dir).select("tx_id", "card_id", "risk_score", "decision", "decision_ms")
    path, found = fresh_path(spark, "audit"), fresh_path(spark, "audit-lookup")
    audit.upsert_batch(rows, path, 0)
    audit.upsert_batch(rows.filter(F.col("tx_id") % 5 == 0).withColumn("decision", F.lit("DECLINE")), path, 1)
    audit.write_by_transaction(audit.current_rows(spark, path), found)
    return spark.read.parquet(found)


_REVISED = """SELECT tx_id, card_id, risk_score, CASE WHEN tx_id%5=0 THEN 'DECLINE' ELSE decision END AS decision, ts_ms AS decision_ms
  FROM scored WHERE {}"""


@query("s12_point_lookup", on_scores(_REVISED.format("tx_id=775"), with_p=True))
def s12_point_lookup(spark, sf_dir):
    return audit.find_transaction(_lookup_table(spark, sf_dir), 775)


@query("s12_lookup_of_orders", on_scores(_REVISED.format("tx_id IN (SELECT o_orderkey FROM orders)"), with_p=True))
def s12_lookup_of_orders(spark, sf_dir):
    """All transactions that a table of ids asks for."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"))
    return audit.find_transactions(_lookup_table(spark, sf_dir), wanted)


_CARD_FROM, _CARD_TO = EPOCH_2024_MS + 3 * 86_400_000, EPOCH_2024_MS + 25 * 86_400_000


@query(
    "s13_card_time_range",
    f"WITH {SPARSE} SELECT tx_id, card_id, ts_ms, amount FROM tx WHERE card_id=8 AND ts_ms BETWEEN {_CARD_FROM} AND {_CARD_TO}",
)
def s13_card_time_range(spark, sf_dir):
    path = fresh_path(spark, "monthly")
    audit.write_monthly(tx_sparse(spark, sf_dir).select("tx_id", "card_id", "ts_ms", "amount"), path)
    return audit.by_card_and_time(spark.read.parquet(path), 8, _CARD_FROM, _CARD_TO).drop("yyyymm")


_FAILURE = audit.Failure("transactions.raw", "scoring-realtime")


def _dead_letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = request_rows(spark, sf_dir)
    return audit.split_dead_letters(rows, requests.transaction_errors(), _FAILURE, F.col("received_ms"))


@query(
    "s11_dead_letters",
    f"""WITH {_CHECKED} SELECT request_id, 'transactions.raw' AS original_topic, 'scoring-realtime' AS consumer_group,
      errors AS failure_reason, 3 AS attempt_count, received_ms AS first_failure_ms, received_ms AS last_failure_ms,
      'ValidationException' AS exception_class FROM checked WHERE errors IS NOT NULL""",
)
def s11_dead_letters(spark, sf_dir):
    dead = _dead_letters(spark, sf_dir)[1]
    return dead.withColumn("request_id", F.get_json_object("payload", "$.request_id").cast("long")).drop("payload")


query("s11_good_rows", f"WITH {_CHECKED} SELECT request_id, card_id FROM checked WHERE errors IS NULL")(
    lambda spark, sf_dir: _dead_letters(spark, sf_dir)[0].select("request_id", "card_id")
)


@query(
    "s17_dead_letter_replay",
    f"""WITH {_CHECKED} SELECT 'transactions.raw' AS original_topic, request_id, card_id, CAST(amount AS DOUBLE) AS amount, country
    FROM checked WHERE errors IS NOT NULL AND auth_errors IS NULL""",
)
def s17_dead_letter_replay(spark, sf_dir):
    """Dead letters that pass once the checks on country, category and channel are lifted."""
    dead = _dead_letters(spark, sf_dir)[1]
    again = audit.replay_dead_letters(dead, request_rows(spark, sf_dir).schema, requests.authentication_errors())
    return again.select("original_topic", "request_id", "card_id", F.col("amount").cast("double").alias("amount"), "country")


@query(
    "s17_dead_letters_again",
    f"""WITH {_CHECKED} SELECT request_id, 4 AS attempt_count, auth_errors AS failure_reason, last_ms > first_ms AS later
    FROM (SELECT *, 1 AS first_ms, 2 AS last_ms FROM checked) WHERE errors IS NOT NULL AND auth_errors IS NOT NULL""",
)
def s17_dead_letters_again(spark, sf_dir):
    """Those of the replayed dead letters that fail again, counted."""
    dead = _dead_letters(spark, sf_dir)[1].withColumns({"first_failure_ms": F.lit(1), "last_failure_ms": F.lit(1)})
    schema = request_rows(spark, sf_dir).schema
    again = audit.dead_again(dead, schema, requests.authentication_errors(), F.lit(2))
    return again.select(
        F.from_json("payload", schema)["request_id"].alias("request_id"),
        "attempt_count",
        "failure_reason",
        (F.col("last_failure_ms") > F.col("first_failure_ms")).alias("later"),
    )


@query("p15_masked_card", "SELECT c_custkey, repeat('*', length(c_name)-4) || right(c_name,4) AS masked FROM customer")
def p15_masked_card(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_card(F.col("c_name")).alias("masked"))


@query(
    "p18_retention",
    """SELECT o_orderkey, o_orderdate >= TIMESTAMP '1999-06-01' - INTERVAL 90 DAYS AS in_transactions,
      o_orderdate >= TIMESTAMP '1999-06-01' - INTERVAL 30 DAYS AS in_devices
    FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01' - INTERVAL 1 YEAR""",
)
def p18_retention(spark, sf_dir):
    as_of = F.expr("TIMESTAMP_NTZ '1999-06-01'")
    kept = audit.retained(table(spark, sf_dir, "orders"), "audit", as_of, "o_orderdate")
    day = F.col("o_orderdate")
    return kept.select(
        "o_orderkey",
        (day >= as_of - F.expr(audit.RETENTION["transactions"])).alias("in_transactions"),
        (day >= as_of - F.expr(audit.RETENTION["devices"])).alias("in_devices"),
    )


query(
    "p18_analytics_retention",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01' - INTERVAL 24 MONTHS",
)(
    lambda spark, sf_dir: audit.retained(
        table(spark, sf_dir, "orders"), "analytics", F.expr("TIMESTAMP_NTZ '1999-06-01'"), "o_orderdate"
    ).select("o_orderkey")
)

# --- timelines ---------------------------------------------------------------------------------

# Types of audit events.
EVENT_TYPES = [
    "TRANSACTION_INGESTED",
    "TRANSACTION_ENRICHED",
    "TRANSACTION_SCORED",
    "THREEDS_ASSESSED",
    "THREEDS_CHALLENGE_INITIATED",
    "THREEDS_CHALLENGE_COMPLETED",
    "DECISION_FINALIZED",
    "MANUAL_REVIEW_QUEUED",
    "MANUAL_REVIEW_COMPLETED",
    "FRAUD_CONFIRMED",
    "CHARGEBACK_RECEIVED",
]


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(kind) for kind in EVENT_TYPES])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"),
        F.element_at(kinds, F.col("l_linenumber")).alias("event_type"),
        F.col("l_shipdate").cast("timestamp").alias("event_ts"),
        F.col("l_linenumber").alias("event_id"),
    )


_EVENTS = "ev AS (SELECT l_orderkey AS tx_id, [{}][l_linenumber] AS event_type, l_shipdate AS event_ts, l_linenumber AS event_id FROM lineitem)".format(
    ",".join(f"'{kind}'" for kind in EVENT_TYPES)
)


@query(
    "o01_last_transactions",
    f"""WITH {DENSE} SELECT card_id, tx_id, ts_ms, CAST(row_number() OVER (PARTITION BY card_id ORDER BY ts_ms DESC, tx_id) AS INTEGER) AS rank
    FROM tx QUALIFY rank<=5""",
)
def o01_last_transactions(spark, sf_dir):
    return audit.last_per_card(tx_dense(spark, sf_dir), 5).select("card_id", "tx_id", "ts_ms", "rank")


@query(
    "o02_timeline",
    f"""WITH {_EVENTS} SELECT tx_id, event_type, epoch_us(event_ts)//1000 AS event_ms FROM ev
    WHERE event_type IN ('TRANSACTION_SCORED','DECISION_FINALIZED','TRANSACTION_INGESTED')
      AND event_ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '2000-12-31' ORDER BY tx_id, event_ms, event_type""",
)
def o02_timeline(spark, sf_dir):
    found = audit.timeline(
        audit_events(spark, sf_dir),
        ["TRANSACTION_SCORED", "DECISION_FINALIZED", "TRANSACTION_INGESTED"],
        F.lit("1998-01-01").cast("timestamp"),
        F.lit("2000-12-31").cast("timestamp"),
    )
    return found.select("tx_id", "event_type", F.unix_millis("event_ts").alias("event_ms"))


_LIFECYCLE = f"""WITH {_EVENTS} SELECT tx_id, 0 AS page, string_agg(event_type || '@' || epoch_us(event_ts)//1000, ','
  ORDER BY event_ts, event_type, event_id) AS events, count(*) AS event_count FROM ev GROUP BY tx_id"""


def _lifecycle_text(rows: DataFrame) -> DataFrame:
    entry = lambda e: F.concat(e["event_type"], F.lit("@"), F.unix_millis(e["event_ts"]).cast("string"))
    return rows.withColumn("events", F.array_join(F.transform("events", entry), ","))


query("o03_lifecycle", _LIFECYCLE)(lambda spark, sf_dir: _lifecycle_text(audit.lifecycles(audit_events(spark, sf_dir))))
query(
    "o03_lifecycle_paged",
    f"""WITH {_EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY tx_id ORDER BY event_ts, event_type, event_id)-1)//3 AS page, count(*) OVER (PARTITION BY tx_id) AS total FROM ev)
    SELECT tx_id, CAST(page AS INTEGER) AS page, string_agg(event_type || '@' || epoch_us(event_ts)//1000, ','
      ORDER BY event_ts, event_type, event_id) AS events, any_value(total) AS event_count FROM n GROUP BY tx_id, page""",
)(lambda spark, sf_dir: _lifecycle_text(audit.lifecycles(audit_events(spark, sf_dir), page_rows=3, max_rows=6)))
query(
    "o03_lifecycle_total",
    f"""WITH {_EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY tx_id ORDER BY event_ts, event_type, event_id)-1)//2 AS page,
      count(*) OVER (PARTITION BY tx_id) AS total FROM ev)
    SELECT tx_id, CAST(page AS INTEGER) AS page, count(*) AS on_page, any_value(total) AS event_count FROM n GROUP BY tx_id, page""",
)(
    lambda spark, sf_dir: audit.lifecycles(audit_events(spark, sf_dir), page_rows=2).select(
        "tx_id", "page", F.size("events").cast("long").alias("on_page"), "event_count"
    )
)
query("a18_event_counts", f"WITH {_EVENTS} SELECT tx_id, count(*) AS event_count FROM ev WHERE event_type<>'TRANSACTION_ENRICHED' GROUP BY 1")(
    lambda spark, sf_dir: audit.event_counts(audit_events(spark, sf_dir).filter(F.col("event_type") != "TRANSACTION_ENRICHED"))
)

# --- sets --------------------------------------------------------------------------------------


@query(
    "u01_topics_as_one",
    on_scores(
        """SELECT 'fraud.decisions' AS topic, tx_id, decision, NULL::VARCHAR AS reason FROM scored
        UNION ALL SELECT 'fraud.alerts', tx_id, NULL, 'CRITICAL' FROM scored WHERE risk_band='CRITICAL'""",
        with_p=True,
    ),
)
def u01_topics_as_one(spark, sf_dir):
    rows = decisions(spark, sf_dir)
    critical = rows.filter(scoring.risk_band(F.col("risk_score")) == "CRITICAL").select("tx_id", F.lit("CRITICAL").alias("reason"))
    return audit.union_topics(**{"fraud.decisions": rows.select("tx_id", "decision"), "fraud.alerts": critical})


@query("u02_redelivered_once", f"WITH {DENSE} SELECT tx_id, card_id, amount FROM tx")
def u02_redelivered_once(spark, sf_dir):
    """Every row sent twice, every third one three times."""
    rows = tx_dense(spark, sf_dir).select("tx_id", "card_id", "amount")
    sent = rows.unionByName(rows).unionByName(rows.filter(F.col("tx_id") % 3 == 0))
    return audit.drop_redelivered(sent)


@query(
    "f15_correlation_id",
    f"""WITH {DENSE} SELECT tx_id, CASE WHEN tx_id%4=0 THEN 'unknown-fraud.decisions-' || ts_ms ELSE 'corr-' || tx_id END AS correlation_id FROM tx""",
)
def f15_correlation_id(spark, sf_dir):
    header = F.when(F.col("tx_id") % 4 != 0, F.concat(F.lit("corr-"), F.col("tx_id").cast("string")))
    return tx_dense(spark, sf_dir).select(
        "tx_id", text.correlation_id(header, F.lit("fraud.decisions"), F.col("ts_ms")).alias("correlation_id")
    )


@query("f08_json_to_map", "SELECT event_id AS tx_id, json_extract_string(props,'$.k') AS k, CASE WHEN event_id%9=0 THEN 0 ELSE 1 END AS fields FROM events WHERE event_id%9<>0 UNION ALL SELECT event_id, NULL, 0 FROM events WHERE event_id%9=0")
def f08_json_to_map(spark, sf_dir):
    """Every ninth text is blank or an empty object."""
    body = F.when(F.col("event_id") % 18 == 0, F.lit("  ")).when(F.col("event_id") % 9 == 0, F.lit("{}")).otherwise(F.col("props"))
    parsed = text.json_to_map(body)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_id"),
        F.try_element_at(parsed, F.lit("k")).alias("k"),
        F.size(parsed).alias("fields"),
    )


@query(
    "f09_json_text",
    f"""WITH {DENSE} SELECT tx_id, '{{"tx_id":' || tx_id || ',"note":"say \\"' || channel || '\\" \\\\ ' || country || '"}}' AS body FROM tx""",
)
def f09_json_text(spark, sf_dir):
    note = F.concat(F.lit('say "'), F.col("channel"), F.lit('" \\ '), F.col("country"))
    return tx_dense(spark, sf_dir).select("tx_id", F.to_json(F.struct("tx_id", note.alias("note"))).alias("body"))

"""Scoring, decision analytics and authentication queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions import text
from tallyguard.operators import analytics, authentication, lookups, monitoring, scoring
from tallyguard.operators.model import feature_vector
from tallyguard.operators.rules import DEFAULT_RULES, Rule, in_high_risk_list, python_rule, with_rule_scores
from tallyguard.plans.card_queries import dense_features, dense_scores, rules_text, sparse_features
from tallyguard.plans.oracle import DENSE, SPARSE, on_features, on_scores
from tallyguard.plans.registry import query
from tallyguard.session import cut_lineage
from tallyguard.sources.views import given_probability, props_k, table, tx_dense

# --- rule sums, fusion, decision ---------------------------------------------------------------


@query("a03_rule_sum", on_scores("SELECT tx_id, rule_score, applied_rules FROM scored"))
def a03_rule_sum(spark, sf_dir):
    return with_rule_scores(dense_features(spark, sf_dir)).select("tx_id", "rule_score", rules_text())


_ISOLATED = on_scores(
    """SELECT tx_id, rule_velocity + rule_amount_anomaly + CASE WHEN k%7=0 THEN 0 ELSE 5 END AS rule_score,
      concat_ws(',', CASE WHEN rule_velocity>0 THEN 'VELOCITY' END, CASE WHEN rule_amount_anomaly>0 THEN 'AMOUNT_ANOMALY' END,
        CASE WHEN k%7<>0 THEN 'FRAGILE' END) AS applied_rules,
      CASE WHEN k%7=0 THEN 2 ELSE 3 END AS rules_run
    FROM scored"""
)


def _fragile(spark: SparkSession, sf_dir: str, rule: Rule) -> DataFrame:
    rules = [*DEFAULT_RULES[:2], rule]
    rows = dense_features(spark, sf_dir).withColumn("k", props_k())
    return with_rule_scores(rows, rules).select(
        "tx_id", "rule_score", rules_text(), F.size("rule_scores").alias("rules_run")
    )


@query("r07_failing_rule_is_left_out", _ISOLATED)
def r07_failing_rule_is_left_out(spark, sf_dir):
    """A rule that cannot be computed where ``k`` is a multiple of seven."""
    rule = Rule("FRAGILE", lambda: F.when(F.try_divide(F.lit(1), F.col("k") % 7).isNotNull(), 5))
    return _fragile(spark, sf_dir, rule)


@query("r08_rule_in_pandas", _ISOLATED)
def r08_rule_in_pandas(spark, sf_dir):
    """The same rule written in pandas, raising on the rows it cannot score."""

    def score(frame: pd.DataFrame) -> pd.Series:
        if (frame["k"] % 7 == 0).any():
            raise ValueError("no score")
        return frame["k"] * 0 + 5

    return _fragile(spark, sf_dir, python_rule("FRAGILE", ["k"], score))


@query("r09_fused_score", on_scores("SELECT tx_id, p, risk_score FROM scored", with_p=True))
def r09_fused_score(spark, sf_dir):
    return dense_scores(spark, sf_dir, with_p=True).select("tx_id", "p", "risk_score")


@query("r10_decision", on_scores("SELECT tx_id, risk_score, decision FROM scored", with_p=True))
def r10_decision(spark, sf_dir):
    return dense_scores(spark, sf_dir, with_p=True).select("tx_id", "risk_score", "decision")


@query(
    "r11_score_map",
    on_scores(
        """SELECT tx_id, concat_ws(',', CASE WHEN p IS NOT NULL THEN 'ml.onnx' END, 'rule.AMOUNT_ANOMALY', 'rule.DEVICE_CHANGE',
          'rule.GEO_ANOMALY', 'rule.MERCHANT_CATEGORY', 'rule.TIME_ANOMALY', 'rule.VELOCITY') AS names,
          rule_geo_anomaly::DOUBLE AS geo, p AS ml FROM scored""",
        with_p=True,
    ),
)
def r11_score_map(spark, sf_dir):
    scores = F.col("model_scores")
    return dense_scores(spark, sf_dir, with_p=True).select(
        "tx_id",
        F.array_join(F.array_sort(F.map_keys(scores)), ",").alias("names"),
        scores["rule.GEO_ANOMALY"].alias("geo"),
        F.try_element_at(scores, F.lit("ml.onnx")).alias("ml"),
    )


@query(
    "r12_decision_rows",
    on_scores(
        """SELECT tx_id, card_id, merchant_id, risk_score, decision, applied_rules, rule_velocity::DOUBLE AS velocity_part,
          p AS ml_part, 0::BIGINT AS latency_ms, ts_ms AS decision_ms FROM scored""",
        with_p=True,
    ),
)
def r12_decision_rows(spark, sf_dir):
    rows = scoring.decision_rows(dense_scores(spark, sf_dir, with_p=True))
    scores = F.col("model_scores")
    return rows.select(
        "tx_id", "card_id", "merchant_id", "risk_score", "decision", rules_text(),
        scores["rule.VELOCITY"].alias("velocity_part"),
        F.try_element_at(scores, F.lit("ml.onnx")).alias("ml_part"),
        "latency_ms", "decision_ms",
    )


@query(
    "r12_score_sparse",
    on_scores("SELECT tx_id, card_id, rule_score, risk_score, decision, applied_rules FROM scored", SPARSE),
)
def r12_score_sparse(spark, sf_dir):
    scored = scoring.score_transactions(sparse_features(spark, sf_dir))
    return scored.select("tx_id", "card_id", "rule_score", "risk_score", "decision", rules_text())


@query("r14_rules_only", on_scores("SELECT tx_id, risk_score, decision, true AS fallback_used FROM scored"))
def r14_rules_only(spark, sf_dir):
    return dense_scores(spark, sf_dir).select("tx_id", "risk_score", "decision", "fallback_used")


@query("p20_fallback_flag", on_scores("SELECT tx_id, p IS NULL AS fallback_used FROM scored", with_p=True))
def p20_fallback_flag(spark, sf_dir):
    return dense_scores(spark, sf_dir, with_p=True).select("tx_id", "fallback_used")


_VECTOR = [
    "amount", "avg_amount_7d", "tx_count_1h", "tx_count_6h", "tx_count_24h", "distinct_merchants_24h", "velocity_score",
    "CAST(country_changed AS INTEGER)", "time_since_last_tx_ms/3600000.0::DOUBLE",
]


@query(
    "p12_feature_vector",
    on_features(
        "SELECT tx_id, " + ", ".join(f"CAST(CAST({x} AS FLOAT) AS DOUBLE) AS v{i}" for i, x in enumerate(_VECTOR)) + " FROM feat"
    ),
)
def p12_feature_vector(spark, sf_dir):
    rows = dense_features(spark, sf_dir).select("tx_id", feature_vector().alias("v"))
    return rows.select("tx_id", *[F.col("v")[i].cast("double").alias(f"v{i}") for i in range(9)])


@query("p16_risk_band", on_scores("SELECT tx_id, risk_score, risk_band FROM scored", with_p=True))
def p16_risk_band(spark, sf_dir):
    rows = dense_scores(spark, sf_dir, with_p=True)
    return rows.select("tx_id", "risk_score", scoring.risk_band(F.col("risk_score")).alias("risk_band"))


@query("p17_critical_rows", on_scores("SELECT tx_id, card_id, risk_score FROM scored WHERE risk_band='CRITICAL'", with_p=True))
def p17_critical_rows(spark, sf_dir):
    rows = dense_scores(spark, sf_dir, with_p=True)
    return rows.filter(scoring.risk_band(F.col("risk_score")) == "CRITICAL").select("tx_id", "card_id", "risk_score")


@query(
    "j08_high_risk_categories",
    f"WITH {DENSE} SELECT tx_id, mcc FROM tx WHERE mcc IN (SELECT DISTINCT mcc FROM tx WHERE amount>200)",
)
def j08_high_risk_categories(spark, sf_dir):
    """Membership in a list kept as a table: categories with a large amount."""
    rows = tx_dense(spark, sf_dir)
    return in_high_risk_list(rows, rows.filter(F.col("amount") > 200)).select("tx_id", "mcc")


@query("f13_clamp", f"WITH {DENSE} SELECT tx_id, greatest(0.25::DOUBLE, least(0.75::DOUBLE, k/99.0::DOUBLE)) AS clamped FROM tx")
def f13_clamp(spark, sf_dir):
    value = props_k() / F.lit(99.0)
    return tx_dense(spark, sf_dir).select("tx_id", text.clamp(value, F.lit(0.25), F.lit(0.75)).alias("clamped"))


@query(
    "f14_case_insensitive",
    f"WITH {DENSE} SELECT tx_id, upper(lower(channel)) AS channel, lower(channel)='ecom' AS is_ecom FROM tx",
)
def f14_case_insensitive(spark, sf_dir):
    lower = F.lower("channel")
    return tx_dense(spark, sf_dir).select(
        "tx_id", F.upper(lower).alias("channel"), text.same_text(lower, F.lit("ECOM")).alias("is_ecom")
    )


# --- decision analytics ------------------------------------------------------------------------


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("decided_at", F.timestamp_millis("ts_ms"))


_LABELS = "labelled AS (SELECT s.*, l.toxic AS is_confirmed_fraud FROM scored s LEFT JOIN labels l ON l.doc_id=s.tx_id)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("tx_id"), F.col("toxic").alias("is_confirmed_fraud"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.with_outcomes(dense_scores(spark, sf_dir), _labels(spark, sf_dir))


@query(
    "a01_decline_spikes",
    on_scores(
        """SELECT merchant, ts_ms//300000*300000 AS window_start_ms, ts_ms//300000*300000+300000 AS window_end_ms,
          count(*) AS total_count, count(*) FILTER (WHERE decision='DECLINE') AS decline_count, 2 AS threshold
        FROM (SELECT *, merchant_id%4 AS merchant FROM scored) GROUP BY ALL HAVING decline_count>2"""
    ),
)
def a01_decline_spikes(spark, sf_dir):
    rows = _timed(dense_scores(spark, sf_dir)).withColumn("merchant", F.col("merchant_id") % 4)
    return analytics.decline_spikes(rows, threshold=2, keys=["merchant"])


_JSON_ALERT = """SELECT CAST(merchant AS VARCHAR) AS key, '{"alertType":"MERCHANT_DECLINE_SPIKE","merchantId":"' || merchant
  || '","windowStart":"' || strftime(make_timestamp(w*1000), '%Y-%m-%dT%H:%M:%SZ') || '","windowEnd":"'
  || strftime(make_timestamp((w+300000)*1000), '%Y-%m-%dT%H:%M:%SZ') || '","declineCount":' || d
  || ',"threshold":2,"generatedAt":"2024-01-31T00:00:00Z"}' AS value
FROM (SELECT merchant_id%4 AS merchant, ts_ms//300000*300000 AS w, count(*) FILTER (WHERE decision='DECLINE') AS d
  FROM scored GROUP BY ALL) WHERE d>2"""


@query("s05_alert_json", on_scores(_JSON_ALERT))
def s05_alert_json(spark, sf_dir):
    rows = _timed(dense_scores(spark, sf_dir)).withColumn("merchant_id", F.col("merchant_id") % 4)
    return analytics.spike_json(analytics.decline_spikes(rows, threshold=2), F.lit(1_706_659_200_000))


@query(
    "a04_hourly_velocity",
    on_scores(
        """SELECT card_id, ts_ms//3600000*3600000 AS hour_ms, count(*) AS tx_count,
          CAST(sum(CAST(round(amount*10000) AS BIGINT)) AS DOUBLE)/10000.0::DOUBLE AS total_amount,
          CAST(sum(is_confirmed_fraud) AS BIGINT) AS fraud_count FROM labelled GROUP BY 1,2""",
        more=_LABELS,
    ),
)
def a04_hourly_velocity(spark, sf_dir):
    rows = lookups.with_outcomes(tx_dense(spark, sf_dir), _labels(spark, sf_dir))
    return analytics.hourly_velocity(rows)


_DISTRIBUTION = """SELECT CAST(make_timestamp(ts_ms*1000) AS DATE) AS date, risk_band, decision, count(*) AS tx_count,
  CAST(sum(CAST(round(amount*10000) AS BIGINT)) AS DOUBLE)/10000.0::DOUBLE AS total_amount FROM scored GROUP BY 1,2,3"""


@query("a05_decision_distribution", on_scores(_DISTRIBUTION, SPARSE, with_p=True))
def a05_decision_distribution(spark, sf_dir):
    rows = sparse_features(spark, sf_dir).withColumn("p", given_probability())
    return analytics.decision_distribution(scoring.score_transactions(rows, "p"))


@query(
    "a06_merged_partials",
    f"""WITH {SPARSE} SELECT card_id, ts_ms//3600000*3600000 AS hour_ms, count(*) AS tx_count,
      CAST(sum(CAST(round(amount*10000) AS BIGINT)) AS BIGINT) AS units FROM tx GROUP BY 1,2""",
)
def a06_merged_partials(spark, sf_dir):
    """Sums of the odd rows merged into those of the even ones."""

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy("card_id", text.hour_start_ms(F.col("ts_ms")).alias("hour_ms")).agg(
            F.count(F.lit(1)).alias("tx_count"), F.sum(F.round(F.col("amount") * 10000).cast("long")).alias("units")
        )

    from tallyguard.sources.views import tx_sparse

    rows = tx_sparse(spark, sf_dir)
    halves = [partial(rows.filter(F.col("tx_id") % 2 == side)) for side in (0, 1)]
    return analytics.merge_partials(*halves, ["card_id", "hour_ms"])


_RATES = """rates AS (SELECT ts_ms//300000*300000 AS window_ms, count(*) AS total, count(*) FILTER (WHERE decision='DECLINE') AS declines
  FROM scored GROUP BY 1)"""


@query(
    "a09_fraud_rate",
    on_scores(
        """SELECT window_ms, total, declines, declines::DOUBLE/total::DOUBLE AS fraud_rate,
          declines::DOUBLE/total::DOUBLE>0.1 AS alert FROM rates""",
        more=_RATES,
    ),
)
def a09_fraud_rate(spark, sf_dir):
    return monitoring.fraud_rate(dense_scores(spark, sf_dir))


@query(
    "a10_decision_shares",
    on_scores(
        """SELECT ts_ms//300000*300000 AS window_ms, count(*) AS total,
          count(*) FILTER (WHERE decision='APPROVE')::DOUBLE/count(*)::DOUBLE AS approve_share,
          count(*) FILTER (WHERE decision='CHALLENGE')::DOUBLE/count(*)::DOUBLE AS challenge_share,
          count(*) FILTER (WHERE decision='DECLINE')::DOUBLE/count(*)::DOUBLE AS decline_share FROM scored GROUP BY 1"""
    ),
)
def a10_decision_shares(spark, sf_dir):
    return monitoring.decision_shares(dense_scores(spark, sf_dir))


_GRID = """span AS (SELECT min(window_ms) AS a, max(window_ms) AS b FROM rates),
grid AS (SELECT unnest(generate_series(a, b, 300000)) AS window_ms FROM span),
series AS (SELECT window_ms, declines::DOUBLE/total::DOUBLE AS fraud_rate FROM grid LEFT JOIN rates USING (window_ms)),
spikes AS (SELECT window_ms, fraud_rate, avg(fraud_rate) OVER (ORDER BY window_ms RANGE BETWEEN 3300000 PRECEDING AND CURRENT ROW) AS hour_mean
  FROM series)"""


_BY_CHANNEL = """crates AS (SELECT channel, ts_ms//300000*300000 AS window_ms, count(*) FILTER (WHERE decision='DECLINE')::DOUBLE/count(*)::DOUBLE AS fraud_rate
  FROM scored GROUP BY 1, 2),
cgrid AS (SELECT channel, unnest(generate_series(min(window_ms), max(window_ms), 300000)) AS window_ms FROM crates GROUP BY channel),
cseries AS (SELECT channel, window_ms, fraud_rate FROM cgrid LEFT JOIN crates USING (channel, window_ms))"""


@query(
    "w16_fraud_rate_spike_by_channel",
    on_scores(
        """SELECT channel, window_ms, fraud_rate, round(hour_mean,9) AS hour_mean, coalesce(fraud_rate>hour_mean*2,false) AS spike FROM (
        SELECT *, avg(fraud_rate) OVER (PARTITION BY channel ORDER BY window_ms RANGE BETWEEN 3300000 PRECEDING AND CURRENT ROW) AS hour_mean FROM cseries)""",
        more=_BY_CHANNEL,
    ),
)
def w16_fraud_rate_spike_by_channel(spark, sf_dir):
    rates = monitoring.fraud_rate(dense_scores(spark, sf_dir), keys=["channel"])
    return monitoring.fraud_rate_spikes(rates, keys=["channel"]).withColumn("hour_mean", F.round("hour_mean", 9))


@query(
    "w17_sustained_alert_by_channel",
    on_scores(
        """SELECT channel, window_ms, min(CASE WHEN fraud_rate>0.03 THEN 1 ELSE 0 END) OVER s = 1 AND count(*) OVER s = 3 AS firing FROM cseries
        WINDOW s AS (PARTITION BY channel ORDER BY window_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)""",
        more=_BY_CHANNEL,
    ),
)
def w17_sustained_alert_by_channel(spark, sf_dir):
    series = monitoring.on_full_grid(monitoring.fraud_rate(dense_scores(spark, sf_dir), keys=["channel"]), ["channel"])
    return monitoring.sustained(series, F.col("fraud_rate") > 0.03, 600_000, keys=["channel"]).select("channel", "window_ms", "firing")


@query(
    "w16_fraud_rate_spike",
    on_scores(
        """SELECT window_ms, fraud_rate, round(hour_mean,9) AS hour_mean, coalesce(fraud_rate>hour_mean*2,false) AS spike FROM spikes""",
        more=f"{_RATES}, {_GRID}",
    ),
)
def w16_fraud_rate_spike(spark, sf_dir):
    spikes = monitoring.fraud_rate_spikes(monitoring.fraud_rate(dense_scores(spark, sf_dir)))
    return spikes.withColumn("hour_mean", F.round("hour_mean", 9))


@query(
    "w17_sustained_alert",
    on_scores(
        """SELECT window_ms, min(CASE WHEN fraud_rate>0.03 THEN 1 ELSE 0 END) OVER s = 1 AND count(*) OVER s = 3 AS firing FROM series
        WINDOW s AS (ORDER BY window_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)""",
        more=f"{_RATES}, {_GRID}",
    ),
)
def w17_sustained_alert(spark, sf_dir):
    """Fraud rate above 3 % at every step of ten minutes."""
    series = monitoring.on_full_grid(monitoring.fraud_rate(dense_scores(spark, sf_dir)))
    return monitoring.sustained(series, F.col("fraud_rate") > 0.03, 600_000).select("window_ms", "firing")


@query("a19_counts_by_status", on_scores("SELECT ts_ms//60000*60000 AS window_ms, decision AS status, count(*) AS n FROM scored GROUP BY 1,2"))
def a19_counts_by_status(spark, sf_dir):
    return monitoring.counts_by_status(dense_scores(spark, sf_dir), "decision")


# --- labels, replies, training rows ------------------------------------------------------------


@query("j05_outcomes", on_scores("SELECT tx_id, decision, is_confirmed_fraud FROM labelled", more=_LABELS))
def j05_outcomes(spark, sf_dir):
    return _labelled(spark, sf_dir).select("tx_id", "decision", "is_confirmed_fraud")


@query(
    "s15_training_rows",
    on_scores(
        """SELECT tx_id, card_id, amount, tx_count_1h, avg_amount_7d, velocity_score, risk_score, decision, is_confirmed_fraud
        FROM labelled WHERE is_confirmed_fraud IS NOT NULL""",
        more=_LABELS,
    ),
)
def s15_training_rows(spark, sf_dir):
    return _labelled(spark, sf_dir).filter(F.col("is_confirmed_fraud").isNotNull()).select(
        "tx_id", "card_id", "amount", "tx_count_1h", "avg_amount_7d", "velocity_score", "risk_score", "decision", "is_confirmed_fraud"
    )


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = dense_scores(spark, sf_dir).withColumn("k", props_k())
    requests = tx_dense(spark, sf_dir).select("tx_id", F.col("ts_ms").alias("request_ms"))
    replies = scored.select(
        "tx_id", (F.col("ts_ms") + F.col("k")).alias("reply_ms"), "risk_score", "decision", "applied_rules",
        F.col("k").cast("long").alias("latency_ms"),
    )
    return lookups.correlate_replies(requests, replies)


@query(
    "j03_reply_in_time",
    f"WITH {DENSE} SELECT tx_id, ts_ms AS request_ms, CASE WHEN k<=45 THEN ts_ms+k END AS reply_ms, k>45 AS timed_out FROM tx",
)
def j03_reply_in_time(spark, sf_dir):
    return _correlated(spark, sf_dir).select("tx_id", "request_ms", "reply_ms", "timed_out")


@query(
    "j03_two_replies",
    f"WITH {DENSE} SELECT tx_id, ts_ms AS request_ms, CASE WHEN k<=45 THEN ts_ms+k END AS reply_ms, k>45 AS timed_out FROM tx",
)
def j03_two_replies(spark, sf_dir):
    """A second reply comes two milliseconds after each first one, and every third first one twice."""
    rows = tx_dense(spark, sf_dir).withColumn("k", props_k())
    first = rows.select("tx_id", (F.col("ts_ms") + F.col("k")).alias("reply_ms"))
    replies = first.unionByName(first.withColumn("reply_ms", F.col("reply_ms") + 2)).unionByName(first.filter(F.col("tx_id") % 3 == 0))
    return lookups.correlate_replies(rows.select("tx_id", F.col("ts_ms").alias("request_ms")), replies)


@query(
    "j05_newest_outcome",
    f"""WITH {DENSE} SELECT tx_id, tx_id%2=0 AS is_confirmed_fraud, CASE WHEN tx_id%2=0 THEN ts_ms+5 END AS chargeback_at,
      'second' AS reviewed_by FROM tx""",
)
def j05_newest_outcome(spark, sf_dir):
    """An outcome is corrected by a later one."""
    rows = tx_dense(spark, sf_dir)
    even = F.col("tx_id") % 2 == 0
    first = rows.select("tx_id", F.lit(1).alias("outcome_ms"), (~even).alias("is_confirmed_fraud"), F.col("ts_ms").alias("chargeback_at"), F.lit("first").alias("reviewed_by"))
    second = rows.select("tx_id", F.lit(2).alias("outcome_ms"), even.alias("is_confirmed_fraud"), F.when(even, F.col("ts_ms") + 5).alias("chargeback_at"), F.lit("second").alias("reviewed_by"))
    return lookups.with_outcomes(rows.select("tx_id"), second.unionByName(first))


@query(
    "j04_fallback_response",
    on_scores(
        """SELECT tx_id AS request_id, CASE WHEN k<=45 THEN tx_id END AS tx_id, CASE WHEN k<=45 THEN risk_score ELSE 0 END AS risk_score,
          CASE WHEN k<=45 THEN decision ELSE 'APPROVE' END AS decision,
          CASE WHEN k<=45 THEN applied_rules ELSE 'ASYNC_REVIEW_REQUIRED' END AS applied_rules,
          CASE WHEN k<=45 THEN k ELSE 0 END::BIGINT AS latency_ms FROM scored"""
    ),
)
def j04_fallback_response(spark, sf_dir):
    responses = lookups.with_fallback(_correlated(spark, sf_dir))
    return responses.withColumn("applied_rules", rules_text())


# --- 3-D Secure --------------------------------------------------------------------------------

_STATUS = "CASE WHEN risk_score<=300 THEN 'Y' WHEN risk_score<=700 THEN 'C' ELSE 'R' END"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = dense_scores(spark, sf_dir, with_p=True)
    return authentication.assess(tx_dense(spark, sf_dir).select("tx_id"), scored)


@query(
    "r16_authentication_status",
    on_scores(f"SELECT tx_id, risk_score, {_STATUS} AS trans_status, {_STATUS}='C' AS challenge_mandated FROM scored", with_p=True),
)
def r16_authentication_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("tx_id", "risk_score", "trans_status", "challenge_mandated")


@query(
    "r17_fallback_score",
    on_scores(
        f"SELECT tx_id, risk_score, {_STATUS} AS trans_status FROM (SELECT tx_id, CASE WHEN tx_id%10=0 THEN 850 ELSE risk_score END AS risk_score FROM scored)",
        with_p=True,
    ),
)
def r17_fallback_score(spark, sf_dir):
    """Every tenth request has no score."""
    scored = dense_scores(spark, sf_dir, with_p=True).filter(F.col("tx_id") % 10 != 0)
    return authentication.assess(tx_dense(spark, sf_dir).select("tx_id"), scored).select("tx_id", "risk_score", "trans_status")


@query(
    "r21_authentication_flow",
    on_scores(
        f"SELECT tx_id, CASE {_STATUS} WHEN 'Y' THEN 'FRICTIONLESS' WHEN 'C' THEN 'CHALLENGE' ELSE 'REJECTED' END AS flow FROM scored",
        with_p=True,
    ),
)
def r21_authentication_flow(spark, sf_dir):
    return _statuses(spark, sf_dir).select("tx_id", "flow")


_SESSIONS = """sessions AS (SELECT tx_id AS trans_id, risk_score, ts_ms FROM scored WHERE decision='CHALLENGE'),
results AS (
  SELECT trans_id, CASE WHEN trans_id%5=0 THEN 'N' WHEN trans_id%7=0 THEN 'y' ELSE 'Y' END AS result_status FROM sessions WHERE trans_id%3<>0
  UNION ALL SELECT trans_id+1000000000, 'Y' FROM sessions WHERE trans_id%11=0),
done AS (SELECT trans_id, risk_score, upper(result_status)='Y' AS ok FROM results JOIN sessions USING (trans_id))"""


def sessions_and_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = dense_scores(spark, sf_dir)
    # Both sides come from the scored rows: written once instead of scored for each use.
    sessions = cut_lineage(
        scored.filter(F.col("decision") == "CHALLENGE").select(F.col("tx_id").alias("trans_id"), "risk_score", "ts_ms")
    )
    trans = F.col("trans_id")
    status = F.when(trans % 5 == 0, "N").when(trans % 7 == 0, "y").otherwise("Y").alias("result_status")
    answered = sessions.filter(trans % 3 != 0).select("trans_id", status)
    stray = sessions.filter(trans % 11 == 0).select((trans + 1_000_000_000).alias("trans_id"), F.lit("Y").alias("result_status"))
    return sessions, answered.unionByName(stray)


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authentication.complete_challenges(*sessions_and_results(spark, sf_dir))


query(
    "r18_challenge_outcome",
    on_scores(
        "SELECT trans_id, CASE WHEN ok THEN 'Y' ELSE 'N' END AS trans_status, CASE WHEN ok THEN 'COMPLETED' ELSE 'FAILED' END AS state FROM done",
        more=_SESSIONS,
    ),
)(lambda spark, sf_dir: _completed(spark, sf_dir).select("trans_id", "trans_status", "state"))
query(
    "r19_eci",
    on_scores(
        "SELECT trans_id, risk_score, CASE WHEN NOT ok THEN '07' WHEN risk_score%2=0 THEN '05' ELSE '02' END AS eci FROM done",
        more=_SESSIONS,
    ),
)(lambda spark, sf_dir: _completed(spark, sf_dir).select("trans_id", "risk_score", "eci"))
query(
    "r20_outcome_action",
    on_scores("SELECT trans_id, CASE WHEN ok THEN 'APPROVE' ELSE 'DECLINE' END AS action FROM done", more=_SESSIONS),
)(lambda spark, sf_dir: _completed(spark, sf_dir).select("trans_id", "action"))
query("j06_known_sessions", on_scores("SELECT trans_id, risk_score FROM done", more=_SESSIONS))(
    lambda spark, sf_dir: _completed(spark, sf_dir).select("trans_id", "risk_score")
)
query(
    "j06_unknown_sessions",
    on_scores("SELECT trans_id, result_status FROM results WHERE trans_id NOT IN (SELECT trans_id FROM sessions)", more=_SESSIONS),
)(lambda spark, sf_dir: authentication.unknown_results(*sessions_and_results(spark, sf_dir)))
query(
    "t10_session_states",
    on_scores(
        """SELECT trans_id, CASE WHEN ok IS NULL THEN 'PENDING' WHEN ok THEN 'COMPLETED' ELSE 'FAILED' END AS state
        FROM sessions LEFT JOIN done USING (trans_id)""",
        more=_SESSIONS,
    ),
)(lambda spark, sf_dir: authentication.session_states(*sessions_and_results(spark, sf_dir)).select("trans_id", "state"))
query(
    "a17_active_sessions",
    on_scores(
        "SELECT count(*) AS active_sessions FROM sessions WHERE trans_id NOT IN (SELECT trans_id FROM done)", more=_SESSIONS
    ),
)(
    lambda spark, sf_dir: authentication.active_sessions(
        authentication.session_states(*sessions_and_results(spark, sf_dir))
    )
)


@query(
    "u03_final_decisions",
    on_scores(
        """SELECT tx_id, coalesce(CASE WHEN ok THEN 'APPROVE' WHEN NOT ok THEN 'DECLINE' END, decision) AS decision
        FROM scored LEFT JOIN done ON trans_id=tx_id""",
        more=_SESSIONS,
    ),
)
def u03_final_decisions(spark, sf_dir):
    """Outcomes of challenges, a minute later, replace the first decision."""
    from tallyguard.operators.audit import final_decisions

    sessions, results = sessions_and_results(spark, sf_dir)
    outcomes = authentication.complete_challenges(sessions, results).join(sessions.select("trans_id", "ts_ms"), "trans_id")
    log = dense_scores(spark, sf_dir).select("tx_id", "decision", F.col("ts_ms").alias("decision_ms"))
    appended = outcomes.select(
        F.col("trans_id").alias("tx_id"), F.col("action").alias("decision"), (F.col("ts_ms") + 60_000).alias("decision_ms")
    )
    return final_decisions(log, appended).select("tx_id", "decision")


# --- model -------------------------------------------------------------------------------------


@query("r13_ml_probability")
def r13_ml_probability(spark, sf_dir):
    """Boosted trees trained on the labelled rows, then applied to all."""
    from tallyguard.operators.model import train_trees, with_ml_probability

    features = dense_features(spark, sf_dir)
    labelled = lookups.with_outcomes(features, _labels(spark, sf_dir)).filter(F.col("is_confirmed_fraud").isNotNull())
    scored = scoring.score_transactions(with_ml_probability(features, train_trees(labelled, rounds=5)), "p")
    return scored.select("tx_id", "p", "risk_score", "decision")

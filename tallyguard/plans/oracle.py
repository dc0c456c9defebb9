"""SQL building blocks for the comparison queries: views, features and scores."""

from __future__ import annotations

from tallyguard.sources.views import DENSE_FACTOR, EPOCH_2024_MS, MCC_CODES, SPARSE_STRETCH

_MCC = ",".join(f"'{code}'" for code in MCC_CODES)


def transactions(factor: int = 1, where: str = "", stretch: int = 1) -> str:
    return f"""tx AS (
  SELECT event_id AS tx_id, user_id AS card_id,
    {EPOCH_2024_MS} + ((epoch_us(ts)//1000) - {EPOCH_2024_MS}) * {stretch} // {factor} AS ts_ms,
    value AS amount, (event_id*7+user_id)%40 AS merchant_id, [{_MCC}][1+event_id%10] AS mcc,
    CASE WHEN event_id%3=0 THEN 'ATM' WHEN event_id%3=1 THEN 'POS' ELSE 'ECOM' END AS channel,
    CASE WHEN (event_id*31+user_id)%20<3 THEN 'GB' WHEN (event_id*31+user_id)%20=3 THEN '' ELSE 'US' END AS country,
    'dev' || CAST((event_id//97+user_id)%2 AS VARCHAR) AS device, event_type, props,
    CAST(json_extract_string(props,'$.k') AS INTEGER) AS k
  FROM events {where})"""


DENSE = transactions(DENSE_FACTOR)
SPARSE = transactions(stretch=SPARSE_STRETCH)

FEATURES = """prv AS (
  SELECT *, lag(ts_ms) OVER c AS prev_ts, lag(country) OVER c AS prev_country, lag(device) OVER c AS prev_device,
    CASE WHEN row_number() OVER (PARTITION BY card_id, ts_ms, merchant_id ORDER BY tx_id)=1 THEN 1 ELSE 0 END AS once
  FROM tx WINDOW c AS (PARTITION BY card_id ORDER BY ts_ms, tx_id)),
ses AS (
  SELECT *,
    sum(CASE WHEN prev_ts IS NULL OR ts_ms-prev_ts>=604800000 THEN 1 ELSE 0 END) OVER c AS s7,
    sum(CASE WHEN prev_ts IS NULL OR ts_ms-prev_ts>=86400000 THEN 1 ELSE 0 END) OVER c AS s24,
    (prev_ts IS NULL OR ts_ms-prev_ts>=604800000) AS fresh
  FROM prv WINDOW c AS (PARTITION BY card_id ORDER BY ts_ms, tx_id)),
fst AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY card_id, s24, merchant_id ORDER BY ts_ms, tx_id)=1 THEN 1 ELSE 0 END AS first_here
  FROM ses),
cnt AS (
  SELECT *,
    CAST(sum(once) OVER (PARTITION BY card_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_count_1h,
    CAST(sum(once) OVER (PARTITION BY card_id ORDER BY ts_ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_count_6h,
    CAST(sum(once) OVER (PARTITION BY card_id ORDER BY ts_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_count_24h,
    CAST(sum(CAST(round(amount*10000) AS BIGINT)) OVER (PARTITION BY card_id, s7 ORDER BY ts_ms, tx_id) AS DOUBLE)
      / (10000.0::DOUBLE * CAST(count(*) OVER (PARTITION BY card_id, s7 ORDER BY ts_ms, tx_id) AS DOUBLE)) AS avg_amount_7d,
    CAST(sum(first_here) OVER (PARTITION BY card_id, s24 ORDER BY ts_ms, tx_id) AS BIGINT) AS distinct_merchants_24h,
    (NOT fresh AND prev_country<>'' AND prev_country<>country) AS country_changed,
    CAST(CASE WHEN fresh THEN -1 ELSE ts_ms-prev_ts END AS BIGINT) AS time_since_last_tx_ms,
    CASE WHEN NOT fresh AND prev_device<>'' THEN prev_device END AS device_hash
  FROM fst),
feat AS (
  SELECT *, CASE WHEN tx_count_1h>0 THEN
      0.5::DOUBLE*least(CAST(tx_count_1h AS DOUBLE)/10.0::DOUBLE,1.0::DOUBLE)
      + 0.3::DOUBLE*least(CAST(tx_count_6h AS DOUBLE)/20.0::DOUBLE,1.0::DOUBLE)
      + 0.2::DOUBLE*CAST(country_changed AS INTEGER)::DOUBLE ELSE 0.0::DOUBLE END AS velocity_score
  FROM cnt)"""

RULES = """ruled AS (
  SELECT *,
    CASE WHEN tx_count_1h>10 THEN 30 WHEN tx_count_1h>5 THEN 15 ELSE 0 END AS rule_velocity,
    CASE WHEN avg_amount_7d<=0 THEN 0 WHEN amount>avg_amount_7d*3.0::DOUBLE THEN 25 WHEN amount>avg_amount_7d*2.0::DOUBLE THEN 10 ELSE 0 END AS rule_amount_anomaly,
    CASE WHEN country_changed AND time_since_last_tx_ms<3600000 THEN 40 WHEN country_changed THEN 15 ELSE 0 END AS rule_geo_anomaly,
    CASE WHEN mcc IN ('7995','5967','5912','5122') THEN 15 ELSE 0 END AS rule_merchant_category,
    CASE WHEN device<>device_hash THEN 20 ELSE 0 END AS rule_device_change,
    CASE WHEN (ts_ms//3600000)%24 BETWEEN 1 AND 5 THEN 10 ELSE 0 END AS rule_time_anomaly,
    CASE WHEN k%10<>0 THEN k/99.0::DOUBLE END AS p
  FROM feat),
summed AS (
  SELECT *, rule_velocity+rule_amount_anomaly+rule_geo_anomaly+rule_merchant_category+rule_device_change+rule_time_anomaly AS rule_score,
    concat_ws(',',
      CASE WHEN rule_velocity>0 THEN 'VELOCITY' END, CASE WHEN rule_amount_anomaly>0 THEN 'AMOUNT_ANOMALY' END,
      CASE WHEN rule_geo_anomaly>0 THEN 'GEO_ANOMALY' END, CASE WHEN rule_merchant_category>0 THEN 'MERCHANT_CATEGORY' END,
      CASE WHEN rule_device_change>0 THEN 'DEVICE_CHANGE' END, CASE WHEN rule_time_anomaly>0 THEN 'TIME_ANOMALY' END) AS applied_rules
  FROM ruled)"""


def _scored(raw: str) -> str:
    return f"""scored AS (
  SELECT *, CASE WHEN risk_score<=300 THEN 'APPROVE' WHEN risk_score>=700 THEN 'DECLINE' ELSE 'CHALLENGE' END AS decision,
    CASE WHEN risk_score/1000.0::DOUBLE<0.3 THEN 'LOW' WHEN risk_score/1000.0::DOUBLE<0.6 THEN 'MEDIUM'
      WHEN risk_score/1000.0::DOUBLE<=0.85 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band
  FROM (SELECT *, CAST(greatest(0, least(1000, round({raw}))) AS INTEGER) AS risk_score FROM summed))"""


_RULES_ONLY = "CAST(rule_score AS DOUBLE)/140.0::DOUBLE*1000.0::DOUBLE"
SCORED = _scored(_RULES_ONLY)
SCORED_WITH_P = _scored(
    f"CASE WHEN p IS NOT NULL THEN ({_RULES_ONLY})*0.4::DOUBLE + (p*1000.0::DOUBLE)*0.6::DOUBLE ELSE {_RULES_ONLY} END"
)


def on_features(select: str, view: str = DENSE) -> str:
    return f"WITH {view}, {FEATURES} {select}"


def on_scores(select: str, view: str = DENSE, with_p: bool = False, more: str = "") -> str:
    """``select`` over the scored transactions; ``more`` adds further named tables."""
    scored = SCORED_WITH_P if with_p else SCORED
    tail = f", {more}" if more else ""
    return f"WITH {view}, {FEATURES}, {RULES}, {scored}{tail} {select}"

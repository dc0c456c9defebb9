"""Decision analytics: hourly velocity, distribution, alerts, shares, profiles.

All aggregates have partial sums on the map side, so the rows that are exchanged number at most
(map tasks x groups), however uneven the groups are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.text import hour_start_ms, iso_instant, same_text, utc_date
from tallyguard.operators.scoring import risk_band
from tallyguard.operators.skew import null_safe_join

ALERT_WINDOW = "5 minutes"
DEFAULT_DECLINE_THRESHOLD = 10
FIVE_MINUTES_MS = 300_000
DAY_MS = 86_400_000

# Fixed value: type of the decline alert.
DECLINE_ALERT = "MERCHANT_DECLINE_SPIKE"


def is_decline(decision: Column) -> Column:
    return same_text(decision, F.lit("DECLINE"))


def decline_spikes(
    decisions: DataFrame,
    threshold: int = DEFAULT_DECLINE_THRESHOLD,
    keys: Sequence[str] = ("merchant_id",),
    ts: str = "decided_at",
) -> DataFrame:
    """Windows with more declines than ``threshold`` per key; batch or watermarked stream."""
    if threshold <= 0:
        raise ValueError(f"declineThreshold must be positive, got: {threshold}")
    counted = decisions.groupBy(F.window(ts, ALERT_WINDOW), *keys).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(is_decline(F.col("decision"))).alias("decline_count")
    )
    return counted.filter(F.col("decline_count") > threshold).select(
        *keys,
        F.unix_millis("window.start").alias("window_start_ms"),
        F.unix_millis("window.end").alias("window_end_ms"),
        "total_count",
        "decline_count",
        F.lit(threshold).alias("threshold"),
    )


def spike_json(alerts: DataFrame, generated_ms: Column | None = None) -> DataFrame:
    """Alerts as JSON text, keyed by merchant."""
    now = generated_ms if generated_ms is not None else F.unix_millis(F.current_timestamp())
    body = F.struct(
        F.lit(DECLINE_ALERT).alias("alertType"),
        F.col("merchant_id").cast("string").alias("merchantId"),
        iso_instant(F.col("window_start_ms")).alias("windowStart"),
        iso_instant(F.col("window_end_ms")).alias("windowEnd"),
        F.col("decline_count").alias("declineCount"),
        F.col("threshold").alias("threshold"),
        iso_instant(now).alias("generatedAt"),
    )
    return alerts.select(F.col("merchant_id").cast("string").alias("key"), F.to_json(body).alias("value"))


def _units_total(amount: str = "amount") -> Column:
    return F.sum(F.round(F.col(amount) * F.lit(10000.0)).cast("long")) / F.lit(10000.0)


def hourly_velocity(df: DataFrame) -> DataFrame:
    """Per card and hour: transactions, amount, confirmed frauds."""
    return df.groupBy("card_id", hour_start_ms(F.col("ts_ms")).alias("hour_ms")).agg(
        F.count(F.lit(1)).alias("tx_count"),
        _units_total().alias("total_amount"),
        F.sum(F.col("is_confirmed_fraud").cast("long")).alias("fraud_count"),
    )


def decision_distribution(df: DataFrame) -> DataFrame:
    """Per date, risk band and decision: transactions and amount."""
    return df.groupBy(
        utc_date(F.col("ts_ms")).alias("date"), risk_band(F.col("risk_score")).alias("risk_band"), "decision"
    ).agg(F.count(F.lit(1)).alias("tx_count"), _units_total().alias("total_amount"))


def merge_partials(stored: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sums plus those of new batches, by key; every other column is a sum."""
    sums = [c for c in stored.columns if c not in keys]
    return stored.unionByName(added).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def device_profiles(df: DataFrame, as_of_ms: int) -> DataFrame:
    """Per device: first and last seen, cards, transactions of 30 days, ever fraudulent."""
    return df.filter(F.col("device").isNotNull()).groupBy("device").agg(
        F.min("ts_ms").alias("first_seen_ms"),
        F.max("ts_ms").alias("last_seen_ms"),
        F.count_distinct("card_id").alias("card_count"),
        F.count_if((F.col("ts_ms") > as_of_ms - 30 * DAY_MS) & (F.col("ts_ms") <= as_of_ms)).alias("tx_count_30d"),
        F.coalesce(F.max(F.col("is_confirmed_fraud") == 1), F.lit(False)).alias("flagged"),
    )


def device_card_profiles(df: DataFrame) -> DataFrame:
    return df.filter(F.col("device").isNotNull()).groupBy("device", "card_id").agg(
        F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"), F.count(F.lit(1)).alias("tx_count")
    )


def distinct_merchants(df: DataFrame, error: float = 0.02) -> DataFrame:
    """Approximate distinct merchants per card."""
    return df.groupBy("card_id").agg(F.approx_count_distinct("merchant_id", error).alias("merchants"))


def merchant_sketches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable sketches of the merchants per key."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col("merchant_id"), F.lit(12)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merchants"))


def card_sketches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Theta sketches of the cards per key: unlike the ones above they can be subtracted."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg("card_id").alias("sketch"))


def union_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of stored batches or periods as one for each key."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch").alias("sketch"))


def new_cards(sketches: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Per key and period (whole numbers): cards of the period, and those of them that the period
    just before had not. Only sketches are joined, never cards."""
    before = sketches.select(*keys, (F.col(period) + 1).alias(period), F.col("sketch").alias("_before"))
    joined = null_safe_join(sketches, before, [*keys, period], "left")
    fresh = F.when(F.col("_before").isNull(), F.col("sketch")).otherwise(F.theta_difference("sketch", "_before"))
    return joined.select(
        *keys, period, F.theta_sketch_estimate("sketch").alias("cards"), F.theta_sketch_estimate(fresh).alias("new_cards")
    )

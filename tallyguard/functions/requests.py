"""Request validation and record mapping as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.text import is_blank

# Messages and domains of the request records.
TRANSACTION_BLANKS = {
    "card_id": "cardId must not be blank",
    "merchant_id": "merchantId must not be blank",
    "currency": "currency must not be blank",
    "mcc": "mcc must not be blank",
    "channel": "channel must not be blank",
    "country": "country must not be blank",
}
AMOUNT_MISSING = "amount must not be null"
AMOUNT_NOT_POSITIVE = "amount must be positive"
CURRENCY_LENGTH = "currency must be a 3-letter ISO code"
COUNTRY_LENGTH = "country must be a 2-letter ISO code"
AUTH_BLANKS = {
    "card_id": "cardId is required",
    "merchant_id": "merchantId is required",
    "currency": "currency is required",
}
AUTH_AMOUNT_MISSING = "amount is required"
AUTH_AMOUNT_LOW = "amount must be greater than 0"
AUTH_CURRENCY_LENGTH = "currency must be a 3-letter ISO 4217 code"
CHALLENGE_BLANKS = {
    "trans_id": "threeDSServerTransID is required",
    "trans_status": "transStatus is required",
}
DEFAULT_MESSAGE_VERSION = "2.2.0"
CHANNELS = ["POS", "ECOM", "ATM"]
DECISIONS = ["APPROVE", "DECLINE", "CHALLENGE"]


def _messages(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(message)) for failed, message in checks]))


def _blank_checks(messages: Mapping[str, str]) -> list[tuple[Column, str]]:
    return [(is_blank(F.col(field)), message) for field, message in messages.items()]


def transaction_errors() -> Column:
    """Messages of all failed checks of a transaction request; empty when it is valid."""
    return _messages(
        [
            *_blank_checks(TRANSACTION_BLANKS),
            (F.col("amount").isNull(), AMOUNT_MISSING),
            (F.col("amount") <= 0, AMOUNT_NOT_POSITIVE),
            (F.length("currency") != 3, CURRENCY_LENGTH),
            (F.length("country") != 2, COUNTRY_LENGTH),
        ]
    )


def authentication_errors() -> Column:
    return _messages(
        [
            *_blank_checks(AUTH_BLANKS),
            (F.col("amount").isNull(), AUTH_AMOUNT_MISSING),
            (F.col("amount") < F.lit(0.01), AUTH_AMOUNT_LOW),
            (F.length("currency") != 3, AUTH_CURRENCY_LENGTH),
        ]
    )


def challenge_errors() -> Column:
    return _messages(_blank_checks(CHALLENGE_BLANKS))


def error_text(errors: Column) -> Column:
    return F.array_join(F.array_sort(errors), "; ")


def message_version(version: Column) -> Column:
    return F.when(is_blank(version), F.lit(DEFAULT_MESSAGE_VERSION)).otherwise(version)


def channel_or_default(channel: Column) -> Column:
    upper = F.upper(channel)
    return F.when(upper.isin(CHANNELS), upper).otherwise(F.lit("ECOM"))


def request_to_event(requests: DataFrame, tx_id: Column, ts_ms: Column) -> DataFrame:
    """Validated requests to transaction events."""
    return requests.select(
        tx_id.alias("tx_id"),
        "card_id",
        "merchant_id",
        F.col("amount").cast("double").alias("amount"),
        "currency",
        "mcc",
        channel_or_default(F.col("channel")).alias("channel"),
        F.struct(
            F.coalesce(F.col("latitude"), F.lit(0.0)).alias("lat"),
            F.coalesce(F.col("longitude"), F.lit(0.0)).alias("lon"),
            F.col("country").alias("country"),
        ).alias("location"),
        "device_fingerprint",
        ts_ms.alias("ts_ms"),
    )


def decision_to_response(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "tx_id",
        "risk_score",
        "decision",
        F.coalesce(F.col("applied_rules"), F.array().cast("array<string>")).alias("applied_rules"),
        "latency_ms",
    )


def known_decision(decision: Column) -> Column:
    return F.when(decision.isin(DECISIONS), decision).otherwise(F.lit("APPROVE"))


def _whole(field: Column, kind: str, default: int) -> Column:
    digits = F.when(field.rlike(r"^[+-]?[0-9]+$"), field)
    return F.coalesce(digits.try_cast(kind), F.lit(default).cast(kind))


def typed_snapshot(hashes: DataFrame, fields: str = "fields") -> DataFrame:
    """Feature hash (string map) to the typed snapshot, with defaults for what is missing or unreadable."""

    def field(name: str) -> Column:
        return F.try_element_at(F.col(fields), F.lit(name))

    def number(name: str) -> Column:
        return F.coalesce(field(name).try_cast("double"), F.lit(0.0))

    def text(name: str) -> Column:
        return F.nullif(field(name), F.lit(""))

    flag = field("country_changed")
    return hashes.select(
        "card_id",
        _whole(field("tx_count_1h"), "int", 0).alias("tx_count_1h"),
        _whole(field("tx_count_6h"), "int", 0).alias("tx_count_6h"),
        _whole(field("tx_count_24h"), "int", 0).alias("tx_count_24h"),
        number("avg_amount_7d").alias("avg_amount_7d"),
        _whole(field("distinct_merchants_24h"), "int", 0).alias("distinct_merchants_24h"),
        text("last_country").alias("last_country"),
        F.coalesce((flag == "1") | (F.lower(flag) == "true"), F.lit(False)).alias("country_changed"),
        _whole(field("time_since_last_tx_ms"), "bigint", -1).alias("time_since_last_tx_ms"),
        text("device_hash").alias("device_hash"),
        number("velocity_score").alias("velocity_score"),
    )

"""Explicit schemas of the records that flow between the operators."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("country", T.StringType()),
    ]
)

TRANSACTION_REQUEST = T.StructType(
    [
        T.StructField("card_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("amount", T.DecimalType(18, 4)),
        T.StructField("currency", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
    ]
)

TRANSACTION = T.StructType(
    [
        T.StructField("tx_id", T.StringType(), False),
        T.StructField("card_id", T.StringType(), False),
        T.StructField("merchant_id", T.StringType(), False),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("device_fingerprint", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)

CARD_FEATURES = T.StructType(
    [
        T.StructField("card_id", T.StringType(), False),
        T.StructField("tx_count_1h", T.IntegerType()),
        T.StructField("tx_count_6h", T.IntegerType()),
        T.StructField("tx_count_24h", T.IntegerType()),
        T.StructField("avg_amount_7d", T.DoubleType()),
        T.StructField("distinct_merchants_24h", T.IntegerType()),
        T.StructField("last_country", T.StringType()),
        T.StructField("country_changed", T.BooleanType()),
        T.StructField("time_since_last_tx_ms", T.LongType()),
        T.StructField("device_hash", T.StringType()),
        T.StructField("velocity_score", T.DoubleType()),
    ]
)

FRAUD_DECISION = T.StructType(
    [
        T.StructField("tx_id", T.StringType(), False),
        T.StructField("card_id", T.StringType(), False),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("decision", T.StringType()),
        T.StructField("applied_rules", T.ArrayType(T.StringType())),
        T.StructField("model_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("decision_ms", T.LongType()),
    ]
)

DEVICE_FINGERPRINT = T.StructType(
    [
        T.StructField("fingerprint_id", T.StringType(), False),
        T.StructField("card_id", T.StringType()),
        T.StructField("canvas_hash", T.StringType()),
        T.StructField("webgl_hash", T.StringType()),
        T.StructField("screen_resolution", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("behavioral_signals", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts_ms", T.LongType()),
    ]
)

"""Transaction views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping.
EPOCH_2024_MS = 1_704_067_200_000
MCC_CODES = ["5411", "7995", "5812", "5967", "5912", "4111", "5122", "7011", "5999", "5732"]
DENSE_FACTOR = 72
SPARSE_STRETCH = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_transactions(events: DataFrame, factor: int = 1, stretch: int = 1) -> DataFrame:
    """Map the events table to card transactions; ``factor`` squeezes time, ``stretch`` stretches it."""
    event_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    squeezed = f"{EPOCH_2024_MS}L + (event_ms - {EPOCH_2024_MS}L) * {stretch} div {factor}"
    pick = F.element_at(F.array(*[F.lit(code) for code in MCC_CODES]), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
    region = F.pmod(F.col("event_id") * 31 + F.col("user_id"), F.lit(20))
    return events.withColumn("event_ms", event_ms).select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id").alias("card_id"),
        F.expr(squeezed).alias("ts_ms"),
        F.col("value").alias("amount"),
        F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(40)).alias("merchant_id"),
        pick.alias("mcc"),
        F.when(F.col("event_id") % 3 == 0, "ATM").when(F.col("event_id") % 3 == 1, "POS").otherwise("ECOM").alias("channel"),
        F.when(region < 3, "GB").when(region == 3, "").otherwise("US").alias("country"),
        F.concat(F.lit("dev"), F.pmod(F.expr("event_id div 97") + F.col("user_id"), F.lit(2)).cast("string")).alias("device"),
        "event_type",
        "props",
    )


def tx_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, 30 days squeezed into 10 hours."""
    return as_transactions(table(spark, sf_dir, "events"), DENSE_FACTOR)


def tx_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, 30 days stretched to 150, with day and week gaps."""
    return as_transactions(table(spark, sf_dir, "events"), stretch=SPARSE_STRETCH)


def props_k(props: str = "props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def given_probability(props: str = "props"):
    """Stand-in fraud probability ``k / 99``; absent for every tenth value (model not available)."""
    k = props_k(props)
    return F.when(k % 10 != 0, k / F.lit(99.0))

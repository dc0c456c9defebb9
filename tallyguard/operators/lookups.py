"""Joins: as-of snapshots, decisions with transactions, request and reply, labels, sessions, devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators import skew

REPLY_TIMEOUT_MS = 45

# What an outcome adds to a decision.
OUTCOME_COLUMNS = ["is_confirmed_fraud", "chargeback_at", "reviewed_by"]


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """Drop redelivered copies of a looked-up side, so that copies on both sides of a join do not
    multiply. Grouped on the join key: the join needs no further exchange of this side."""
    return df.dropDuplicates(list(keys))


def as_of(
    events: DataFrame,
    snapshots: DataFrame,
    values: Sequence[str],
    snapshot_ms: str = "snapshot_ms",
    max_rows: int | None = skew.DEFAULT_MAX_ROWS,
) -> DataFrame:
    """Left join of each event to its card's newest snapshot not after it.

    Both sides are laid in one sorted sequence per card and the last snapshot is carried forward:
    one exchange, no range join. ``snapshots`` holds one row per card and time.
    """
    own = [F.col(c) for c in events.columns]
    held = F.struct(F.col(snapshot_ms).alias(snapshot_ms), *[F.col(v) for v in values])
    right = snapshots.select(
        "card_id", F.col(snapshot_ms).alias("_at"), F.lit(0).alias("_kind"), held.alias("_snapshot")
    )
    left = events.select("card_id", F.col("ts_ms").alias("_at"), F.lit(1).alias("_kind"), F.struct(*own).alias("_event"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = ["_at", "_kind"]

    def plain(rows: DataFrame) -> DataFrame:
        running = Window.partitionBy("card_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_seen", F.last("_snapshot", ignorenulls=True).over(running))

    def sliced(rows: DataFrame) -> DataFrame:
        rows = skew.with_slice(rows, ["card_id"], order)
        return skew.sliced_last(rows, ["card_id"], order, F.col("_snapshot"), "_seen").drop("_slice")

    found = skew.by_heat(both, ["card_id"], plain, sliced, max_rows).filter(F.col("_kind") == 1)
    return found.select("_event.*", F.col("_seen")[snapshot_ms].alias(snapshot_ms), *[F.col("_seen")[v].alias(v) for v in values])


def decisions_with_transactions(decisions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Fill merchant, amount, country, channel and category of decisions from their transactions."""
    filled = ["merchant_id", "amount", "country", "channel", "mcc"]
    return decisions.drop(*filled).join(one_per_key(transactions.select("tx_id", *filled), "tx_id"), "tx_id", "left")


def correlate_replies(requests: DataFrame, replies: DataFrame, timeout_ms: int = REPLY_TIMEOUT_MS) -> DataFrame:
    """Left join of requests to the reply with their id that came in time; ``timed_out`` otherwise.

    ``requests``: tx_id, request_ms; ``replies``: tx_id, reply_ms and payload.
    """
    payload = [c for c in replies.columns if c != "tx_id"]
    asked = requests.select("tx_id", "request_ms").distinct()
    in_time = F.col("reply_ms").between(F.col("request_ms"), F.col("request_ms") + timeout_ms)
    # Of several replies in time the first one counts; of several at one time, always the same.
    held = F.struct(*payload)
    first = (
        asked.join(replies, "tx_id")
        .filter(in_time)
        .groupBy(F.col("tx_id").alias("_reply_to"), F.col("request_ms").alias("_asked"))
        .agg(F.min_by(held, F.struct("reply_ms", F.to_json(held))).alias("_reply"))
    )
    joined = requests.join(first, (F.col("tx_id") == F.col("_reply_to")) & (F.col("request_ms") == F.col("_asked")), "left")
    return joined.select(*requests.columns, "_reply.*", F.col("_reply_to").isNull().alias("timed_out"))


# The answer given when no reply came in time.
FALLBACK_DECISION = "APPROVE"
FALLBACK_RULE = "ASYNC_REVIEW_REQUIRED"


def with_fallback(correlated: DataFrame) -> DataFrame:
    """Response per request; timed-out ones are approved and marked for review."""
    late = F.col("timed_out")
    return correlated.select(
        F.col("tx_id").alias("request_id"),
        F.when(~late, F.col("tx_id")).alias("tx_id"),
        F.when(late, 0).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(late, FALLBACK_DECISION).otherwise(F.col("decision")).alias("decision"),
        F.when(late, F.array(F.lit(FALLBACK_RULE))).otherwise(F.col("applied_rules")).alias("applied_rules"),
        F.when(late, 0).otherwise(F.col("latency_ms")).cast("long").alias("latency_ms"),
    )


def with_outcomes(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach the nullable outcome columns: the confirmed-fraud flag and, where ``labels`` has them,
    chargeback_at and reviewed_by. Of several outcomes the newest by ``outcome_ms`` counts; without
    that column, or at equal times, a confirmed one."""
    values = [c for c in OUTCOME_COLUMNS if c in labels.columns]
    order = [c for c in ("outcome_ms", *values) if c in labels.columns]
    newest = labels.groupBy("tx_id").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_outcome"))
    return decisions.join(newest.select("tx_id", "_outcome.*"), "tx_id", "left")


def known_pairs(transactions: DataFrame, registered: DataFrame) -> DataFrame:
    """Transactions whose (device, card) pair is registered."""
    return transactions.join(registered.select("device", "card_id").distinct(), ["device", "card_id"], "left_semi").select(
        transactions.columns
    )


def new_pairs(transactions: DataFrame, registered: DataFrame) -> DataFrame:
    """Transactions whose (device, card) pair is not registered."""
    return transactions.join(registered.select("device", "card_id").distinct(), ["device", "card_id"], "left_anti").select(
        transactions.columns
    )


def first_of_pair(transactions: DataFrame, max_rows: int | None = skew.DEFAULT_MAX_ROWS) -> DataFrame:
    """True on the first transaction, by time and id, of each device and card; without a device it is
    never set. A pair with more than ``max_rows`` rows is compared with its first row by a join."""
    keys, order = ["device", "card_id"], F.struct("ts_ms", "tx_id")

    def plain(rows: DataFrame) -> DataFrame:
        # Rows without a device need no order: spread them.
        spread = F.when(F.col("device").isNull(), F.pmod(F.xxhash64("tx_id"), F.lit(1024))).otherwise(0)
        rank = F.row_number().over(Window.partitionBy(*keys, spread).orderBy("ts_ms", "tx_id"))
        return rows.withColumn("is_new_pair", F.col("device").isNotNull() & (rank == 1))

    def sliced(rows: DataFrame) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
        joined = skew.null_safe_join(rows, first, keys, "inner")
        return joined.select(*rows.columns, (F.col("device").isNotNull() & (order == F.col("_first"))).alias("is_new_pair"))

    return skew.by_heat(transactions, keys, plain, sliced, max_rows)


def cards_on_device(transactions: DataFrame, device: str | None = None) -> DataFrame:
    """Cards seen on a device, one row per pair: no array grows with a shared device."""
    rows = transactions if device is None else transactions.filter(F.col("device") == device)
    return rows.filter(F.col("device").isNotNull()).select("device", "card_id").distinct()

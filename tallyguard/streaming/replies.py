"""Requests and their first reply in time on a stream, decided once per stretch of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tallyguard.session import STATE_STORE


def _smallest(rows: Column, shape: StructType, ms: str) -> Column:
    """The row of an array with the smallest time; of several at one time always the same one."""

    def first(best: Column, row: Column) -> Column:
        earlier = (row[ms] < best[ms]) | ((row[ms] == best[ms]) & (row.cast("string") < best.cast("string")))
        return F.when(best.isNull() | earlier, row).otherwise(best)

    return F.reduce(rows, F.lit(None).cast(shape), first)


def _gathered(column: str, shape: DataType) -> Column:
    # Copies are kept once, but maps cannot be compared.
    return F.collect_list(column) if "map<" in shape.simpleString() else F.collect_set(column)


def stream_replies(requests: DataFrame, replies: DataFrame, timeout_ms: int) -> DataFrame:
    """``requests`` (tx_id, request_ms, happened_at and more) and ``replies`` (tx_id, reply_ms,
    happened_at and payload), both with a watermark on happened_at: all columns and timed_out.

    Time is cut into windows twice as long as the timeout, a new one beginning after each timeout. A
    request lies in the first half of exactly one of them, and every reply in time lies in the same
    window. It is answered once the watermark has passed that window: by then every reply in time is
    here, whichever came first, and nothing is kept longer than two timeouts and the watermark's delay.
    """
    spark = requests.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    asked_names = [c for c in requests.columns if c != "happened_at"]
    payload_names = [c for c in replies.columns if c not in ("tx_id", "happened_at")]
    asked = StructType([requests.schema[c] for c in asked_names])
    payload = StructType([replies.schema[c] for c in payload_names])
    left = requests.select(F.col("tx_id"), "happened_at", F.struct(*asked_names).alias("asked"), F.lit(None).cast(payload).alias("payload"))
    right = replies.select(F.col("tx_id"), "happened_at", F.lit(None).cast(asked).alias("asked"), F.struct(*payload_names).alias("payload"))
    half_ms = max(timeout_ms, 1)
    span = F.window("happened_at", f"{2 * half_ms} milliseconds", f"{half_ms} milliseconds")
    rows = left.unionByName(right).select("tx_id", span.alias("span"), "asked", "payload")
    rows = rows.filter(F.col("asked").isNull() | (F.col("asked.request_ms") < F.unix_millis("span.start") + half_ms))
    met = rows.groupBy("tx_id", "span").agg(_gathered("asked", asked).alias("asked"), _gathered("payload", payload).alias("came"))

    times = F.array_distinct(F.transform("asked", lambda row: row["request_ms"]))
    each = F.transform(times, lambda ms: _smallest(F.filter("asked", lambda row: row["request_ms"] == ms), asked, "request_ms"))
    opened = met.select(F.explode(each).alias("asked"), "came")
    in_time = F.filter("came", lambda row: row["reply_ms"].between(F.col("asked.request_ms"), F.col("asked.request_ms") + timeout_ms))
    answered = opened.select("asked", _smallest(in_time, payload, "reply_ms").alias("payload"))
    return answered.select("asked.*", *[F.col("payload")[c].alias(c) for c in payload_names], F.col("payload").isNull().alias("timed_out"))

"""Per-card behavioural features: sliding counts, idle-reset averages, change flags, velocity.

Input: ``card_id, tx_id, ts_ms, amount, merchant_id, country, device``, one row per transaction
(drop redelivered copies first). Rows of a card are ordered by ``(ts_ms, tx_id)``.

Frames and resets:

* 1 h and 6 h counts include both ends; the 24 h count leaves its old end out.
* Rows of one card at the same millisecond and merchant count once in the sliding counts.
* The running mean amount, last country, last device and last time are forgotten after 7 idle
  days, the distinct merchants after 24 idle hours; an idle time of exactly the limit resets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators import skew
from tallyguard.session import cut_lineage

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
WEEK_MS = 7 * DAY_MS

# Oldest offset (ms before the row) still inside each sliding count.
COUNT_FRAMES = {
    "tx_count_1h": HOUR_MS,
    "tx_count_6h": 6 * HOUR_MS,
    "tx_count_24h": DAY_MS - 1,
}

FEATURES = [
    "tx_count_1h",
    "tx_count_6h",
    "tx_count_24h",
    "avg_amount_7d",
    "distinct_merchants_24h",
    "country_changed",
    "time_since_last_tx_ms",
    "device_hash",
    "velocity_score",
]

_ORDER = ["ts_ms", "tx_id"]


def velocity_score(count_1h: Column, count_6h: Column, country_changed: Column) -> Column:
    frequency = F.least(count_1h.cast("double") / F.lit(10.0), F.lit(1.0))
    burst = F.least(count_6h.cast("double") / F.lit(20.0), F.lit(1.0))
    changed = country_changed.cast("double")
    score = F.lit(0.5) * frequency + F.lit(0.3) * burst + F.lit(0.2) * changed
    return F.when(count_1h > 0, score).otherwise(F.lit(0.0))


def _units(amount: Column) -> Column:
    """Whole ten-thousandths, so that sums do not depend on the order of addition."""
    return F.round(amount.cast("double") * F.lit(10000.0)).cast("long")


def _idle_at_least(limit_ms: int) -> Column:
    return F.col("_prev_ts").isNull() | (F.col("ts_ms") - F.col("_prev_ts") >= F.lit(limit_ms))


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns shared by both routes, from previous-row values and session sums."""
    known = "NOT _new_7d AND _prev_country <> '' AND _prev_country <> coalesce(country, '')"
    return (
        df.selectExpr(
            *columns,
            *COUNT_FRAMES,
            "CAST(_units_7d AS DOUBLE) / (10000.0D * CAST(_count_7d AS DOUBLE)) AS avg_amount_7d",
            "distinct_merchants_24h",
            f"coalesce({known}, false) AS country_changed",
            "IF(_new_7d, -1L, ts_ms - _prev_ts) AS time_since_last_tx_ms",
            "IF(NOT _new_7d AND _prev_device <> '', _prev_device, NULL) AS device_hash",
        )
        .withColumn(
            "velocity_score", velocity_score(F.col("tx_count_1h"), F.col("tx_count_6h"), F.col("country_changed"))
        )
        .select(*columns, *FEATURES)
    )


_COUNTED = [
    f"""sum(_counted) OVER (PARTITION BY card_id ORDER BY ts_ms RANGE UNBOUNDED PRECEDING)
      - coalesce(sum(_counted) OVER (PARTITION BY card_id ORDER BY ts_ms
          RANGE BETWEEN UNBOUNDED PRECEDING AND {oldest + 1} PRECEDING), 0) AS {name}"""
    for name, oldest in COUNT_FRAMES.items()
]


def _plain(df: DataFrame) -> DataFrame:
    """One exchange on the card and two sorts serve every feature.

    A sliding count is the difference of two running counts, because running frames cost one
    step per row while a sliding frame is summed again for every row.
    """
    order = "OVER (PARTITION BY card_id ORDER BY ts_ms, tx_id)"
    running = "OVER (PARTITION BY card_id ORDER BY ts_ms, tx_id ROWS UNBOUNDED PRECEDING)"
    columns = df.columns
    new_24h = f"(_prev_ts IS NULL OR ts_ms - _prev_ts >= {DAY_MS}L)"
    return _finish(
        df.repartition("card_id")
        .selectExpr("*", "lag(ts_ms) OVER (PARTITION BY card_id, merchant_id ORDER BY ts_ms, tx_id) AS _prev_same")
        .selectExpr(
            "*",
            f"lag(ts_ms) {order} AS _prev_ts",
            f"lag(coalesce(country, '')) {order} AS _prev_country",
            f"lag(coalesce(device, '')) {order} AS _prev_device",
            f"row_number() {order} AS _n",
            "CAST(round(CAST(amount AS DOUBLE) * 10000.0D) AS BIGINT) AS _units",
            "IF(_prev_same <=> ts_ms, 0L, 1L) AS _counted",
        )
        .selectExpr(
            "*",
            f"_prev_ts IS NULL OR ts_ms - _prev_ts >= {WEEK_MS}L AS _new_7d",
            f"sum(_units) {running} AS _units_run",
            f"max(IF({new_24h}, ts_ms, NULL)) {running} AS _start_24h",
            *_COUNTED,
        )
        .selectExpr("*", f"sum(IF(_prev_same IS NULL OR _prev_same < _start_24h, 1L, 0L)) {running} AS _firsts_run")
        # Less the running totals as they stood just before the current session.
        .selectExpr(
            "*",
            f"_units_run - last(IF(_new_7d, _units_run - _units, NULL), true) {running} AS _units_7d",
            f"_n - last(IF(_new_7d, _n - 1, NULL), true) {running} AS _count_7d",
            f"_firsts_run - last(IF({new_24h}, _firsts_run - 1, NULL), true) {running} AS distinct_merchants_24h",
        ),
        columns,
    )


def _sliced_counts(df: DataFrame) -> DataFrame:
    """Sliding counts per ``(card_id, ts_ms)`` for hot cards.

    Rows are first reduced to one per card and millisecond. Each such instant asks for the
    running count at the old end of every frame; the questions are sorted in among the instants
    and answered by one running sum.
    """
    instants = (
        df.select("card_id", "ts_ms", "merchant_id")
        .distinct()
        .groupBy("card_id", "ts_ms")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    asked = F.array(
        F.struct(F.col("ts_ms").alias("at"), F.lit(0).alias("kind"), F.col("w").alias("w")),
        *[
            F.struct((F.col("ts_ms") - F.lit(oldest + 1)).alias("at"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("w"))
            for kind, oldest in enumerate(COUNT_FRAMES.values(), start=1)
        ],
    )
    points = instants.select("card_id", "ts_ms", F.inline(asked))
    sequence = ["at", "kind"]
    points = skew.sliced_running(
        skew.with_slice(points, ["card_id"], sequence), ["card_id"], sequence, sums={"reached": F.col("w")}
    )
    at_kind = {kind: F.max(F.when(F.col("kind") == kind, F.col("reached"))) for kind in range(len(COUNT_FRAMES) + 1)}
    return points.groupBy("card_id", "ts_ms").agg(
        *[(at_kind[0] - at_kind[kind]).cast("long").alias(name) for kind, name in enumerate(COUNT_FRAMES, start=1)]
    )


def _sliced(df: DataFrame) -> DataFrame:
    """The same features for hot cards, with no task holding a whole card."""
    columns = df.columns
    df = cut_lineage(df)
    counts = _sliced_counts(df)
    df = skew.with_slice(df, ["card_id"], _ORDER).withColumns(
        {
            "_country": F.coalesce(F.col("country"), F.lit("")),
            "_device": F.coalesce(F.col("device"), F.lit("")),
            "_units": _units(F.col("amount")),
        }
    )
    df = skew.sliced_previous(df, ["card_id", "merchant_id"], _ORDER, {"_prev_same": "ts_ms"})
    df = skew.sliced_previous(
        df, ["card_id"], _ORDER, {"_prev_ts": "ts_ms", "_prev_country": "_country", "_prev_device": "_device"}
    )
    df = cut_lineage(df.withColumns({"_new_7d": _idle_at_least(WEEK_MS), "_new_24h": _idle_at_least(DAY_MS)}))
    df = skew.sliced_running(
        df,
        ["card_id"],
        _ORDER,
        maxima={
            "_start_7d": F.when(F.col("_new_7d"), F.col("ts_ms")),
            "_start_24h": F.when(F.col("_new_24h"), F.col("ts_ms")),
        },
    )
    first_here = F.col("_prev_same").isNull() | (F.col("_prev_same") < F.col("_start_24h"))
    df = cut_lineage(df.withColumn("_first_here", first_here.cast("long")))
    df = skew.sliced_running(
        df, ["card_id", "_start_7d"], _ORDER, sums={"_units_7d": F.col("_units"), "_count_7d": F.lit(1).cast("long")}
    )
    df = cut_lineage(df)
    df = skew.sliced_running(
        df, ["card_id", "_start_24h"], _ORDER, sums={"distinct_merchants_24h": F.col("_first_here")}
    )
    df = skew.null_safe_join(df, counts, ["card_id", "ts_ms"])
    return _finish(df, columns)


def card_features(transactions: DataFrame, max_rows_per_card: int | None = skew.DEFAULT_MAX_ROWS) -> DataFrame:
    """Add the nine behavioural features to every transaction."""
    return skew.by_heat(transactions, ["card_id"], _plain, _sliced, max_rows_per_card)

"""Newest state per key, snapshots with expiry and defaults, first-seen flags, strict week figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators import skew
from tallyguard.operators.card_windows import DAY_MS, HOUR_MS, WEEK_MS, _units
from tallyguard.session import cut_lineage

# What an unknown card reads as.
UNKNOWN_CARD = {
    "tx_count_1h": 0,
    "tx_count_6h": 0,
    "tx_count_24h": 0,
    "avg_amount_7d": 0.0,
    "distinct_merchants_24h": 0,
    "last_country": None,
    "country_changed": False,
    "time_since_last_tx_ms": -1,
    "device_hash": None,
    "velocity_score": 0.0,
}


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key. An aggregate, so map tasks keep one row per key each and a
    hot key costs no more than any other."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_newest")).select(*keys, "_newest.*").select(*df.columns)


def card_snapshots(features: DataFrame) -> DataFrame:
    """Last feature values per card; ``device_hash`` is the newest device itself."""
    rows = features.select(
        "card_id",
        "tx_id",
        F.col("ts_ms").alias("last_tx_ms"),
        "tx_count_1h",
        "tx_count_6h",
        "tx_count_24h",
        "avg_amount_7d",
        "distinct_merchants_24h",
        F.nullif(F.col("country"), F.lit("")).alias("last_country"),
        "country_changed",
        "time_since_last_tx_ms",
        F.nullif(F.col("device"), F.lit("")).alias("device_hash"),
        "velocity_score",
    )
    return latest_per_key(rows, ["card_id"], ["last_tx_ms", "tx_id"])


def _default(name: str, df: DataFrame) -> Column:
    return F.lit(UNKNOWN_CARD[name]).cast(df.schema[name].dataType)


def expire(snapshots: DataFrame, as_of_ms: Column) -> DataFrame:
    """Snapshots read at ``as_of_ms``: seven idle days turn them into the defaults."""
    stale = as_of_ms - F.col("last_tx_ms") >= WEEK_MS
    names = [c for c in snapshots.columns if c in UNKNOWN_CARD]
    return snapshots.withColumns(
        {c: F.when(stale, _default(c, snapshots)).otherwise(F.col(c)) for c in names}
    )


def with_snapshot(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Attach each card's snapshot; cards without one get the defaults, no row is dropped."""
    names = [c for c in snapshots.columns if c in UNKNOWN_CARD]
    right = snapshots.select("card_id", *names, F.lit(True).alias("_known"))
    joined = df.join(right, "card_id", "left")
    known = F.col("_known").isNotNull()
    return joined.select(
        *df.columns, *[F.when(known, F.col(c)).otherwise(_default(c, snapshots)).alias(c) for c in names]
    )


def last_merchant(df: DataFrame) -> DataFrame:
    return df.groupBy("card_id").agg(F.max_by("merchant_id", F.struct("ts_ms", "tx_id")).alias("last_merchant_id"))


def new_merchant_flag(df: DataFrame, max_rows: int | None = skew.DEFAULT_MAX_ROWS) -> DataFrame:
    """True on the first transaction of a card at a merchant."""
    keys = ["card_id", "merchant_id"]

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("ts_ms", "tx_id")
        return rows.withColumn("is_new_merchant", F.lag("tx_id").over(order).isNull())

    def sliced(rows: DataFrame) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min(F.struct("ts_ms", "tx_id")).alias("_first"))
        joined = skew.null_safe_join(rows, first, keys, "inner")
        return joined.select(*rows.columns, (F.struct("ts_ms", "tx_id") == F.col("_first")).alias("is_new_merchant"))

    return skew.by_heat(df, keys, plain, sliced, max_rows)


def new_device_flag(df: DataFrame, max_rows: int | None = skew.DEFAULT_MAX_ROWS) -> DataFrame:
    """True while a card's device is less than 24 h old; false without a device."""
    keys = ["card_id", "device"]

    def flag(first: Column) -> Column:
        return F.coalesce(F.col("device").isNotNull() & (F.col("ts_ms") - first < DAY_MS), F.lit(False))

    def plain(rows: DataFrame) -> DataFrame:
        # Rows without a device need no order: spread them.
        spread = F.when(F.col("device").isNull(), F.pmod(F.xxhash64("tx_id"), F.lit(1024))).otherwise(0)
        order = Window.partitionBy(*keys, spread).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("is_new_device", flag(F.min("ts_ms").over(order)))

    def sliced(rows: DataFrame) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min("ts_ms").alias("_first"))
        joined = skew.null_safe_join(rows, first, keys, "inner")
        return joined.select(*rows.columns, flag(F.col("_first")).alias("is_new_device"))

    return skew.by_heat(df, keys, plain, sliced, max_rows)


_WEEK = ["tx_count_7d", "avg_amount_strict_7d", "max_amount_7d"]


def _week_plain(df: DataFrame) -> DataFrame:
    """Running frames only, so time is in proportion to rows. Blocks are as long as the frame: a frame
    is the start of its row's block and the end of the block before, both running maxima (of the
    block's number and the amount, so that a new block starts afresh)."""
    by_time = Window.partitionBy("card_id").orderBy("ts_ms")
    upto = by_time.rangeBetween(Window.unboundedPreceding, 0)
    before = by_time.rangeBetween(Window.unboundedPreceding, -WEEK_MS - 1)
    later = Window.partitionBy("card_id").orderBy(F.desc("ts_ms")).rangeBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.col("ts_ms") / F.lit(WEEK_MS + 1)).cast("long")
    rows = df.withColumns({"_units": _units(F.col("amount")), "_block": block})
    # What follows a row's instant in the next block that has rows.
    rows = rows.withColumn("_rest", F.max(F.struct((-F.col("_block")).alias("back"), F.col("amount").alias("top"))).over(later))
    earlier = F.count(F.lit(1)).over(before)
    count = F.count(F.lit(1)).over(upto) - earlier
    units = F.sum("_units").over(upto) - F.coalesce(F.sum("_units").over(before), F.lit(0))
    head = F.max(F.struct("_block", F.col("amount").alias("top"))).over(upto)["top"]
    rest = F.last("_rest").over(before)
    tail = F.when(-rest["back"] == F.col("_block") - 1, rest["top"])
    return rows.select(
        *df.columns,
        count.alias("tx_count_7d"),
        (units.cast("double") / (F.lit(10000.0) * count.cast("double"))).alias("avg_amount_strict_7d"),
        F.when(earlier == 0, F.max("amount").over(upto)).otherwise(F.greatest(head, tail)).alias("max_amount_7d"),
    )


def _week_sliced(df: DataFrame) -> DataFrame:
    """Hot cards: instants per (card, ms); sums by running differences, the maximum from the first
    hour's tail, the whole hours between, and the last hour's head."""
    df = cut_lineage(df)
    instants = (
        df.withColumn("_units", _units(F.col("amount")))
        .groupBy("card_id", "ts_ms")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_units").alias("units"), F.max("amount").alias("top"))
    )
    zero = F.lit(0).cast("long")
    asked = F.array(
        F.struct((F.col("ts_ms") - WEEK_MS).alias("at"), F.lit(1).alias("kind"), zero.alias("n"), zero.alias("units"), F.lit(None).cast("double").alias("top")),
        F.struct(F.col("ts_ms").alias("at"), F.lit(0).alias("kind"), F.col("n"), F.col("units"), F.col("top")),
    )
    # Slices are hours here: an hour of one card has two points per millisecond at most.
    points = instants.select("card_id", "ts_ms", F.inline(asked))
    points = cut_lineage(points.withColumn("_slice", F.floor(F.col("at") / F.lit(HOUR_MS)).cast("long")))

    # A question at the old end must not count the instant it falls on: it sorts before it here ...
    sums = skew.sliced_running(
        points.withColumn("_late", 1 - F.col("kind")),
        ["card_id"],
        ["at", "_late"],
        sums={"n_run": F.col("n"), "units_run": F.col("units")},
    )
    # ... and after it when looking for the maximum from that instant on.
    tail = Window.partitionBy("card_id", "_slice").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    head = Window.partitionBy("card_id", "_slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hours = WEEK_MS // HOUR_MS
    whole = (
        points.filter(F.col("kind") == 0)
        .groupBy("card_id", "_slice")
        .agg(F.max("top").alias("_top"))
        .withColumn(
            "_between", F.max("_top").over(Window.partitionBy("card_id").orderBy("_slice").rangeBetween(-hours + 1, -1))
        )
        .select("card_id", "_slice", "_between")
    )
    tops = points.withColumns({"_tail": F.max("top").over(tail), "_head": F.max("top").over(head)})
    tops = skew.null_safe_join(tops, whole, ["card_id", "_slice"])

    def of_kind(kind: int, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    counted = sums.groupBy("card_id", "ts_ms").agg(
        (of_kind(0, "n_run") - of_kind(1, "n_run")).alias("tx_count_7d"),
        (of_kind(0, "units_run") - of_kind(1, "units_run")).alias("_units"),
    )
    topped = tops.groupBy("card_id", "ts_ms").agg(
        F.greatest(of_kind(1, "_tail"), of_kind(0, "_between"), of_kind(0, "_head")).alias("max_amount_7d")
    )
    figures = skew.null_safe_join(counted, topped, ["card_id", "ts_ms"], "inner").withColumn(
        "avg_amount_strict_7d",
        F.col("_units").cast("double") / (F.lit(10000.0) * F.col("tx_count_7d").cast("double")),
    )
    return skew.null_safe_join(df, figures, ["card_id", "ts_ms"], "inner").select(*df.columns, *_WEEK)


def strict_week(df: DataFrame, max_rows: int | None = skew.DEFAULT_MAX_ROWS) -> DataFrame:
    """Count, mean and maximum over the closed last seven days of the card."""
    return skew.by_heat(df, ["card_id"], _week_plain, _week_sliced, max_rows)

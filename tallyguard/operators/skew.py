"""Keeping one hot key from becoming one hot task.

A window partitioned by a key puts all rows of the key in one task. Keys with more than
``max_rows`` rows are therefore cut into slices of about equal row count along the window's order:
each ``(key, slice)`` pair is a window of its own, and what a slice needs from earlier ones travels
as one small *carry* row per slice. A range exchange on (key, order) makes the slices, so neither
many rows of one instant nor a NULL key stay together, and a key has at most as many carry rows as
there are slices.

NULL is a key like any other, as it is for a window: all joins here are null-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.session import cut_lineage

DEFAULT_MAX_ROWS = 2_000_000
#: More hot keys than this are joined by shuffle.
MAX_BROADCAST_KEYS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Keys with more than ``max_rows`` rows.

    The count is combined on the map side, and reads the key columns only.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows).select(*keys)


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys are kept once. ``other`` may be a broadcast."""
    named = {k: f"_join_{k}" for k in keys}
    right = other.withColumnsRenamed(named)
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(r)) for k, r in named.items()])
    joined = df.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())


def by_heat(
    df: DataFrame,
    keys: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame], DataFrame],
    max_rows: int | None = DEFAULT_MAX_ROWS,
) -> DataFrame:
    """``plain`` for ordinary keys, ``sliced`` for hot ones; both must return the same columns.

    One small job looks for hot keys and writes them to the shared folder; the driver sees their
    number only. Without any, the plan is that of ``plain`` alone. ``max_rows=None`` skips the look
    (for inputs known to be even).
    """
    if max_rows is None:
        return plain(df)
    hot = cut_lineage(hot_keys(df, keys, max_rows))
    found = hot.count()
    if not found:
        return plain(df)
    if found <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold_part = plain(null_safe_join(df, hot, keys, "left_anti").select(df.columns))
    hot_part = sliced(null_safe_join(df, hot, keys, "left_semi").select(df.columns))
    return cold_part.unionByName(hot_part)


def with_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add ``_slice``: rows ranged by (keys, order) into ``parts`` (the session's shuffle partitions
    by default). Slices ascend with the order, and none holds more rows than another by much. The
    result is written to the shared folder: a range exchange that ran again could cut elsewhere."""
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id().cast("long")))


def sliced_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """Add the value each column of ``values`` (new name -> column) had in the key's previous row.

    Equals ``lag(column)`` over ``(keys, order)``; needs the ``_slice`` column.
    """
    held = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_slice")
    carry = (
        df.groupBy(*keys, "_slice")
        .agg(F.max_by(held, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .select(*keys, "_slice", "_carry")
    )
    joined = null_safe_join(df.withColumn("_prev", F.lag(held).over(local)), carry, [*keys, "_slice"])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return joined.withColumns({name: prev[name] for name in values}).drop("_prev", "_carry")


def sliced_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima, this row included, in ``order`` within ``keys``; needs ``_slice``."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = {**sums, **maxima}
    df = df.withColumns({f"_v_{name}": value for name, value in wanted.items()})
    totals = df.groupBy(*keys, "_slice").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums],
        *[F.max(f"_v_{name}").alias(f"_t_{name}") for name in maxima],
    )
    carry = totals.select(
        *keys,
        "_slice",
        *[F.sum(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name in sums],
        *[F.max(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name in maxima],
    )
    within = df.withColumns(
        {name: F.sum(f"_v_{name}").over(local) for name in sums}
        | {name: F.max(f"_v_{name}").over(local) for name in maxima}
    )
    joined = null_safe_join(within, carry, [*keys, "_slice"])
    joined = joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)) for name in sums}
        | {name: F.greatest(F.col(name), F.col(f"_c_{name}")) for name in maxima}
    )
    return joined.drop(*[f"_v_{n}" for n in wanted], *[f"_c_{n}" for n in wanted])


def sliced_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Latest non-null ``value`` up to and including this row; needs ``_slice``."""
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_held", value)
    carry = (
        df.filter(F.col("_held").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.max_by("_held", F.struct(*order)).alias("_last"))
    )
    # A slice without a value still has to receive its carry.
    slices = df.select(*keys, "_slice").distinct()
    carry = (
        null_safe_join(slices, carry, [*keys, "_slice"])
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .select(*keys, "_slice", "_carry")
    )
    found = F.last("_held", ignorenulls=True).over(local)
    joined = null_safe_join(df.withColumn("_found", found), carry, [*keys, "_slice"])
    return joined.withColumn(name, F.coalesce("_found", "_carry")).drop("_held", "_found", "_carry")

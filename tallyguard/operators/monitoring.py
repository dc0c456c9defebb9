"""Operational series: rates, shares, latency quantiles, throughput, lag, sustained alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators import skew
from tallyguard.operators.analytics import FIVE_MINUTES_MS, is_decline
from tallyguard.session import cut_lineage

MINUTE_MS = 60_000
HOUR_MS = 3_600_000

# Alert limits.
FRAUD_RATE_LIMIT = 0.10
ERROR_RATE_LIMIT = 0.01
P99_LIMIT_MS = 100
P95_LIMIT_MS = 50
GATEWAY_P99_LIMIT_MS = 200
LAG_CRITICAL = 10_000
LAG_WARNING = 5_000
BREAKER_CALLS = 100
BREAKER_RATE = 0.5

# Upper bucket bounds in milliseconds; the last bucket is open.
LATENCY_BOUNDS = [5, 10, 25, 50, 75, 100, 150, 200, 300, 500, 1000]


def window_start(ts_ms: Column, width_ms: int) -> Column:
    return (ts_ms - F.pmod(ts_ms, F.lit(width_ms))).cast("long")


def fraud_rate(decisions: DataFrame, limit: float = FRAUD_RATE_LIMIT, keys: Sequence[str] = ()) -> DataFrame:
    """Share of declines per five minutes."""
    counted = decisions.groupBy(*keys, window_start(F.col("ts_ms"), FIVE_MINUTES_MS).alias("window_ms")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_decline(F.col("decision"))).alias("declines")
    )
    rate = F.try_divide(F.col("declines").cast("double"), F.col("total").cast("double"))
    return counted.withColumn("fraud_rate", rate).withColumn("alert", F.col("fraud_rate") > limit)


def decision_shares(decisions: DataFrame, width_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """Share of each decision per window."""
    total = F.count(F.lit(1)).cast("double")

    def share(name: str) -> Column:
        return (F.count_if(F.col("decision") == name).cast("double") / total).alias(f"{name.lower()}_share")

    return decisions.groupBy(window_start(F.col("ts_ms"), width_ms).alias("window_ms")).agg(
        F.count(F.lit(1)).alias("total"), share("APPROVE"), share("CHALLENGE"), share("DECLINE")
    )


def latency_percentiles(calls: DataFrame, exact: bool = False, width_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """p50, p95, p99 of ``latency_ms`` per window and service, with the alert flags.

    The exact form counts equal latencies first, so that a group holds one entry per distinct
    millisecond; the approximate one keeps a sketch of fixed size.
    """
    keys = ["window_ms", "service"]
    timed = calls.select(window_start(F.col("ts_ms"), width_ms).alias("window_ms"), "service", "latency_ms")
    points = [0.5, 0.95, 0.99]
    if exact:
        tallied = timed.groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("n"))
        found = tallied.groupBy(*keys).agg(
            *[F.percentile("latency_ms", p, F.col("n")).alias(f"p{int(p * 100)}") for p in points]
        )
    else:
        found = timed.groupBy(*keys).agg(F.percentile_approx("latency_ms", points, 10_000).alias("_p")).select(
            *keys, *[F.col("_p")[i].cast("double").alias(f"p{int(p * 100)}") for i, p in enumerate(points)]
        )
    return found.withColumns(
        {
            "p99_alert": F.col("p99") > P99_LIMIT_MS,
            "p95_alert": F.col("p95") > P95_LIMIT_MS,
            "gateway_alert": F.col("p99") > GATEWAY_P99_LIMIT_MS,
        }
    )


# Fixed size of a latency sketch: about 0.7 % of rank error, merged or not.
_SKETCH_K = 400


def latency_sketches(calls: DataFrame, width_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """A quantile sketch of bounded size per window and service. Unlike percentiles, sketches of
    stored windows can be added up (``merged_percentiles``)."""
    timed = calls.select(window_start(F.col("ts_ms"), width_ms).alias("window_ms"), "service", F.col("latency_ms").cast("bigint").alias("ms"))
    return timed.groupBy("window_ms", "service").agg(F.kll_sketch_agg_bigint("ms", _SKETCH_K).alias("sketch"))


def merged_percentiles(sketches: DataFrame, width_ms: int) -> DataFrame:
    """p50, p95 and p99 of wider windows from stored sketches; the calls are not read again."""
    keys = ["window_ms", "service"]
    wide = sketches.select(window_start(F.col("window_ms"), width_ms).alias("window_ms"), "service", "sketch")
    merged = wide.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(
        *keys,
        F.kll_sketch_get_n_bigint("sketch").alias("calls"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)],
    )


def bucket_of(value: Column, bounds: Sequence[float] = LATENCY_BOUNDS) -> Column:
    """Position of the bucket of ``value``; ``len(bounds)`` is the open one."""
    found = F.when(value <= bounds[0], 0)
    for at, bound in enumerate(bounds[1:], start=1):
        found = found.when(value <= bound, at)
    return found.otherwise(len(bounds))


def histogram_quantile(
    calls: DataFrame, quantile: float, keys: Sequence[str], bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets; the open bucket gives the last bound."""
    buckets = calls.groupBy(*keys, bucket_of(F.col("latency_ms"), bounds).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = buckets.withColumns(
        {"reached": F.sum("n").over(upto), "rank": F.sum("n").over(whole).cast("double") * F.lit(float(quantile))}
    )
    first = ranked.filter(F.col("reached") >= F.col("rank")).groupBy(*keys).agg(
        F.min(F.struct("bucket", "reached", "n", "rank")).alias("b")
    )
    upper = F.array(*[F.lit(float(b)) for b in bounds])
    lower = F.array(*[F.lit(float(b)) for b in [0, *bounds[:-1]]])
    at = F.col("b.bucket")
    inside = F.get(lower, at) + (F.get(upper, at) - F.get(lower, at)) * (
        (F.col("b.rank") - (F.col("b.reached") - F.col("b.n")).cast("double")) / F.col("b.n").cast("double")
    )
    return first.select(*keys, F.when(at == len(bounds), F.lit(float(bounds[-1]))).otherwise(inside).alias("quantile_ms"))


def throughput(calls: DataFrame) -> DataFrame:
    """Events per second per service and minute."""
    counted = calls.groupBy(window_start(F.col("ts_ms"), MINUTE_MS).alias("window_ms"), "service").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select("window_ms", "service", (F.col("n").cast("double") / F.lit(60.0)).alias("per_second"))


def error_rate(calls: DataFrame, limit: float = ERROR_RATE_LIMIT) -> DataFrame:
    """Failed over all calls per window and service."""
    counted = calls.groupBy(window_start(F.col("ts_ms"), FIVE_MINUTES_MS).alias("window_ms"), "service").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failures")
    )
    rate = F.col("failures").cast("double") / F.col("calls").cast("double")
    return counted.withColumn("error_rate", rate).withColumn("alert", F.col("error_rate") > limit)


def lag_by_group(lags: DataFrame) -> DataFrame:
    """Summed lag per consumer group and topic, with its severity."""
    summed = lags.groupBy("consumer_group", "topic").agg(F.sum("lag").alias("lag"))
    severity = F.when(F.col("lag") > LAG_CRITICAL, "critical").when(F.col("lag") > LAG_WARNING, "warning")
    return summed.withColumn("severity", severity).filter(F.col("severity").isNotNull())


def counts_by_status(df: DataFrame, status: str, width_ms: int = MINUTE_MS) -> DataFrame:
    return df.groupBy(window_start(F.col("ts_ms"), width_ms).alias("window_ms"), F.col(status).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- series over windows: their length is the time span over the step, not the row count ------


def on_full_grid(series: DataFrame, keys: Sequence[str] = (), step_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """Add the windows nothing fell into, per key (their other columns are null)."""
    span = series.groupBy(*keys).agg(F.min("window_ms").alias("a"), F.max("window_ms").alias("b")).filter(F.col("a").isNotNull())
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.lit(step_ms))).alias("window_ms"))
    return skew.null_safe_join(grid, series, [*keys, "window_ms"])


def fraud_rate_spikes(rates: DataFrame, factor: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Five-minute rate above ``factor`` times the mean of the last hour's twelve rates, per key. The
    series is written once: its span and the grid's join would compute it twice."""
    hour = Window.partitionBy(*keys).orderBy("window_ms").rangeBetween(-(HOUR_MS - FIVE_MINUTES_MS), 0)
    series = on_full_grid(cut_lineage(rates.select(*keys, "window_ms", "fraud_rate")), keys)
    series = series.withColumn("hour_mean", F.avg("fraud_rate").over(hour))
    spike = F.coalesce(F.col("fraud_rate") > F.col("hour_mean") * factor, F.lit(False))
    return series.withColumn("spike", spike)


def sustained(
    series: DataFrame, condition: Column, hold_ms: int, step_ms: int = FIVE_MINUTES_MS, keys: Sequence[str] = ()
) -> DataFrame:
    """True where the condition held at every step of the closed last ``hold_ms``, per key."""
    span = Window.partitionBy(*keys).orderBy("window_ms").rangeBetween(-hold_ms, 0)
    held = F.coalesce(condition, F.lit(False)).cast("int")
    df = series.withColumn("_held", held)
    firing = (F.min("_held").over(span) == 1) & (F.count(F.lit(1)).over(span) == hold_ms // step_ms + 1)
    return df.withColumn("firing", firing).drop("_held")


# --- failure rate over the last calls ---------------------------------------------------------


def breaker_state(
    calls: DataFrame,
    size: int = BREAKER_CALLS,
    limit: float = BREAKER_RATE,
    max_rows: int | None = skew.DEFAULT_MAX_ROWS,
    block_rows: int = 100_000,
) -> DataFrame:
    """Failure rate over each service's last ``size`` calls, and whether it opens the breaker.

    A busy service is cut into blocks of ``block_rows`` calls; the ``size - 1`` calls before a
    block are copied into it, so that every block is a task of its own.
    """
    order = ["ts_ms", "call_id"]

    def over(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
        return rows.withColumns(
            {"window_calls": F.count(F.lit(1)).over(last), "window_failures": F.sum(F.col("failed").cast("long")).over(last)}
        )

    def plain(rows: DataFrame) -> DataFrame:
        return over(rows, ["service"])

    def sliced(rows: DataFrame) -> DataFrame:
        numbered = skew.sliced_running(
            skew.with_slice(rows, ["service"], order), ["service"], order, sums={"_at": F.lit(1).cast("long")}
        )
        at = F.col("_at") - 1
        block = F.floor(at / F.lit(block_rows)).cast("long")
        tail = F.pmod(at, F.lit(block_rows)) >= block_rows - (size - 1)
        blocks = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
        spread = numbered.withColumns({"_own": block, "_block": F.explode(blocks)})
        return over(spread, ["service", "_block"]).filter(F.col("_own") == F.col("_block")).select(
            *rows.columns, "window_calls", "window_failures"
        )

    seen = skew.by_heat(calls, ["service"], plain, sliced, max_rows)
    rate = F.col("window_failures").cast("double") / F.col("window_calls").cast("double")
    return seen.withColumn("failure_rate", rate).withColumn(
        "opens", (F.col("window_calls") == size) & (F.col("failure_rate") >= limit)
    )

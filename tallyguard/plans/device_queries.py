"""Device, trace and service-call queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.operators import analytics, devices, lookups, monitoring
from tallyguard.plans.card_queries import AS_OF_MS
from tallyguard.plans.oracle import DENSE, SPARSE
from tallyguard.plans.registry import query
from tallyguard.sources.views import as_transactions, props_k, table, tx_dense, tx_sparse

# --- fingerprints and signals ------------------------------------------------------------------


def _signals() -> tuple:
    first = F.create_map(
        F.lit("screen.width"), props_k().cast("string"), F.lit("browser.language"), F.col("event_type")
    )
    second = F.create_map(
        F.lit("tz.offset"), (F.col("card_id") % 24).cast("string"), F.lit("screen.width"), (F.col("tx_id") % 9).cast("string")
    )
    return first, second


_SHA = "sha256('browser.language=' || event_type || '|screen.width=' || k)"
query("f01_fingerprint", f"WITH {DENSE} SELECT tx_id, {_SHA} AS fingerprint FROM tx")(
    lambda spark, sf_dir: tx_dense(spark, sf_dir).select("tx_id", devices.fingerprint(_signals()[0]).alias("fingerprint"))
)


def _as_text(signals):
    pairs = F.transform(F.array_sort(F.map_entries(signals)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, "|")


@query(
    "f02_merged_signals",
    f"""WITH {DENSE} SELECT tx_id, 'browser.language=' || event_type || '|screen.width=' || tx_id%9 || '|tz.offset=' || card_id%24 AS signals FROM tx""",
)
def f02_merged_signals(spark, sf_dir):
    return tx_dense(spark, sf_dir).select("tx_id", _as_text(devices.merge_signals(*_signals())).alias("signals"))


@query(
    "f07_signal_defaults",
    f"""WITH {DENSE} SELECT tx_id, 'browser.cookiesEnabled=' || CASE WHEN tx_id%2=0 THEN 'true' ELSE 'false' END
      || '|browser.doNotTrack=' || CASE WHEN tx_id%3=0 THEN '1' ELSE 'unspecified' END
      || '|browser.hardwareConcurrency=' || CASE WHEN tx_id%5=0 THEN '0' ELSE CAST(k AS VARCHAR) END
      || '|browser.language=' || event_type AS signals FROM tx""",
)
def f07_signal_defaults(spark, sf_dir):
    tx = F.col("tx_id")
    signals = devices.signal_defaults(
        {
            "language": F.col("event_type"),
            "cookiesEnabled": tx % 2 == 0,
            "doNotTrack": F.when(tx % 3 == 0, "1"),
            "hardwareConcurrency": F.when(tx % 5 != 0, props_k()),
        }
    )
    return tx_dense(spark, sf_dir).select("tx_id", _as_text(signals).alias("signals"))


# Traces of a user and hour, in one payload row: as many of the newest samples as each trace keeps.


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {**devices.WEB_LIMITS, **devices.MOBILE_LIMITS}
    newest_of = lambda trace, limit: devices.last_samples(trace, limits[limit])
    rows = tx_dense(spark, sf_dir).select(
        "card_id",
        F.expr("ts_ms div 3600000").alias("hour"),
        "tx_id",
        F.struct(
            F.col("amount").alias("x"), props_k().cast("double").alias("y"), (F.col("tx_id") % 10).cast("double").alias("z")
        ).alias("sample"),
        (props_k() / F.lit(99.0)).alias("pressure"),
        F.col("tx_id").alias("stroke"),
    )
    # The newest of each kind hold the newest of all kinds and the newest touches.
    rows = rows.withColumn("pressed", F.coalesce(F.col("pressure") > 0.5, F.lit(False)))
    newest = devices.keep_last(rows, ["card_id", "hour", "pressed"], ["tx_id"], max(limits.values()))
    ordered = F.array_sort(F.collect_list(F.struct("tx_id", "sample", "pressure", "stroke")))
    traces = newest.groupBy("card_id", "hour").agg(ordered.alias("trace"))
    return traces.select(
        "card_id",
        "hour",
        newest_of(F.col("trace.sample"), "mouse").alias("mouse"),
        newest_of(F.col("trace.sample"), "acceleration").alias("samples"),
        newest_of(F.filter("trace.pressure", lambda p: p > 0.5), "touch").alias("touches"),
        newest_of(F.filter("trace.pressure", lambda p: p > 0.5), "pressure").alias("pressures"),
        newest_of(F.col("trace.stroke"), "keys").alias("strokes"),
    )


_TRACES = f"""{DENSE}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY card_id, hour ORDER BY tx_id DESC) AS nth,
    row_number() OVER (PARTITION BY card_id, hour, pressed ORDER BY tx_id DESC) AS nth_pressed
  FROM (SELECT *, ts_ms//3600000 AS hour, coalesce(k/99.0>0.5, false) AS pressed FROM tx)
  QUALIFY nth<=200)"""


@query(
    "f03_trace_counts",
    f"""WITH {_TRACES} SELECT card_id, hour, 'behavioral.keystrokeIntervals=' || count(*) FILTER (WHERE nth<=100) || '|behavioral.mouseMovements=' || count(*)
      || '|behavioral.touchEvents=' || count(*) FILTER (WHERE pressed) AS signals FROM kept GROUP BY 1,2""",
)
def f03_trace_counts(spark, sf_dir):
    counts = devices.trace_counts(F.col("mouse"), F.col("strokes"), F.col("touches"))
    return payloads(spark, sf_dir).select("card_id", "hour", _as_text(counts).alias("signals"))


@query(
    "f04_mean_acceleration",
    f"""WITH {_TRACES} SELECT card_id, hour, printf('%.4f', avg(sqrt(amount*amount + k::DOUBLE*k + (tx_id%10)::DOUBLE*(tx_id%10)))) AS mean
    FROM kept WHERE nth<=100 GROUP BY 1,2""",
)
def f04_mean_acceleration(spark, sf_dir):
    return payloads(spark, sf_dir).select("card_id", "hour", devices.mean_acceleration(F.col("samples")).alias("mean"))


@query(
    "f05_mean_pressure",
    f"""WITH {_TRACES} SELECT card_id, hour, coalesce(printf('%.4f', avg(k/99.0::DOUBLE) FILTER (WHERE pressed AND nth_pressed<=50)), '0') AS mean FROM kept GROUP BY 1,2""",
)
def f05_mean_pressure(spark, sf_dir):
    return payloads(spark, sf_dir).select("card_id", "hour", devices.mean_pressure(F.col("pressures")).alias("mean"))


@query(
    "f06_mean_interval",
    f"WITH {_TRACES} SELECT card_id, hour, CAST(CAST(floor(avg(tx_id%4000)+0.5) AS BIGINT) AS VARCHAR) AS mean FROM kept WHERE nth<=100 GROUP BY 1,2",
)
def f06_mean_interval(spark, sf_dir):
    intervals = F.transform("strokes", lambda s: s % 4000)
    return payloads(spark, sf_dir).select("card_id", "hour", devices.mean_interval(intervals).alias("mean"))


@query(
    "f03_mobile_signals",
    f"""WITH {_TRACES} SELECT card_id, hour, 'behavioral.accelSampleCount=' || count(*) FILTER (WHERE nth<=100)
      || '|behavioral.avgAccelMagnitude=' || printf('%.4f', avg(sqrt(amount*amount + k::DOUBLE*k + (tx_id%10)::DOUBLE*(tx_id%10))) FILTER (WHERE nth<=100))
      || '|behavioral.avgKeystrokeIntervalMs=' || CAST(CAST(floor(avg(tx_id%4000) FILTER (WHERE nth<=100)+0.5) AS BIGINT) AS VARCHAR)
      || '|behavioral.avgTouchPressure=' || coalesce(printf('%.4f', avg(k/99.0::DOUBLE) FILTER (WHERE pressed AND nth_pressed<=50)), '0')
      || '|behavioral.keystrokeCount=' || count(*) FILTER (WHERE nth<=100)
      || '|behavioral.touchPressureCount=' || count(*) FILTER (WHERE pressed AND nth_pressed<=50) AS signals FROM kept GROUP BY 1,2""",
)
def f03_mobile_signals(spark, sf_dir):
    intervals = F.transform("strokes", lambda s: s % 4000)
    signals = devices.mobile_signals(F.col("samples"), F.col("pressures"), intervals)
    return payloads(spark, sf_dir).select("card_id", "hour", _as_text(signals).alias("signals"))


@query(
    "w20_last_samples",
    f"""WITH {DENSE} SELECT card_id, string_agg(CAST(tx_id AS VARCHAR), ',' ORDER BY tx_id) AS kept FROM (
      SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY tx_id DESC)<=20) GROUP BY 1""",
)
def w20_last_samples(spark, sf_dir):
    """The newest 50 rows of a card, of which the array form keeps 20."""
    rows = devices.keep_last(tx_dense(spark, sf_dir).select("card_id", "tx_id"), ["card_id"], ["tx_id"], 50)
    traces = rows.groupBy("card_id").agg(F.array_sort(F.collect_list("tx_id")).alias("ids"))
    return traces.select("card_id", F.array_join(devices.last_samples(F.col("ids"), 20).cast("array<string>"), ",").alias("kept"))


def _strokes(spark: SparkSession, sf_dir: str, squeeze: int, sessions: str) -> DataFrame:
    rows = as_transactions(table(spark, sf_dir, "events"), squeeze)
    return rows.selectExpr(f"{sessions} AS session_id", "ts_ms AS t", "tx_id AS seq")


_INTERVALS = """WITH {tx} SELECT session_id, t, seq, interval_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, seq DESC) AS r FROM (
    SELECT card_id%10 AS session_id, ts_ms AS t, tx_id AS seq,
      ts_ms - lag(ts_ms) OVER (PARTITION BY card_id%10 ORDER BY ts_ms, tx_id) AS interval_ms FROM tx)
  WHERE interval_ms>0 AND interval_ms<5000) WHERE r<=100"""


def _intervals(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        strokes = _strokes(spark, sf_dir, 300, "card_id%10")
        return devices.keystroke_intervals(strokes, **options).select("session_id", "t", "seq", "interval_ms")

    return run


_SQUEEZED = DENSE.replace("// 72", "// 300")
query("w19_keystroke_intervals", _INTERVALS.format(tx=_SQUEEZED))(_intervals())
query("w19_keystroke_intervals_hot_sessions", _INTERVALS.format(tx=_SQUEEZED))(_intervals(max_rows=50))


_HOLDS = """WITH {tx} SELECT session_id, t, seq, hold_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, seq DESC) AS r FROM (
    SELECT card_id%10 AS session_id, ts_ms AS t, tx_id AS seq, tx_id%2=0 AS pressed,
      lag(tx_id%2=0) OVER w AS was, ts_ms - lag(ts_ms) OVER w AS hold_ms
    FROM tx WINDOW w AS (PARTITION BY card_id%10 ORDER BY ts_ms, tx_id))
  WHERE was AND NOT pressed) WHERE r<=100"""


def _holds(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = _strokes(spark, sf_dir, 300, "card_id%10").withColumn("pressed", F.col("seq") % 2 == 0)
        return devices.key_holds(events, **options).select("session_id", "t", "seq", "hold_ms")

    return run


query("w19_key_holds", _HOLDS.format(tx=_SQUEEZED))(_holds())
query("w19_key_holds_hot_sessions", _HOLDS.format(tx=_SQUEEZED))(_holds(max_rows=50))


_SPACED = """WITH RECURSIVE {tx}, pts AS (SELECT card_id%10 AS session_id, ts_ms AS t, min(tx_id) AS seq FROM tx GROUP BY 1,2),
kept AS (
  SELECT session_id, min(t) AS t FROM pts GROUP BY 1
  UNION ALL
  SELECT k.session_id, p.t FROM kept k, LATERAL (SELECT min(t) AS t FROM pts q WHERE q.session_id=k.session_id AND q.t>=k.t+50) p WHERE p.t IS NOT NULL)
SELECT session_id, t, seq FROM kept JOIN pts USING (session_id, t)"""


def _downsampled(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return devices.downsample(_strokes(spark, sf_dir, 72_000, "card_id%10"), **options)

    return run


query("w21_min_spacing", _SPACED.format(tx=DENSE.replace("// 72", "// 72000")))(_downsampled())
query("w21_min_spacing_hot_sessions", _SPACED.format(tx=DENSE.replace("// 72", "// 72000")))(_downsampled(max_rows=50, slice_ms=500))

# --- device profiles ---------------------------------------------------------------------------


@query(
    "a07_device_profiles",
    f"""WITH {SPARSE} SELECT device, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms, count(DISTINCT card_id) AS card_count,
      count(*) FILTER (WHERE ts_ms>{AS_OF_MS}-86400000*20-86400000*10 AND ts_ms<={AS_OF_MS}) AS tx_count_30d,
      coalesce(max(toxic)=1,false) AS flagged FROM tx LEFT JOIN labels ON doc_id=tx_id GROUP BY 1""",
)
def a07_device_profiles(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("tx_id"), F.col("toxic").alias("is_confirmed_fraud"))
    return analytics.device_profiles(lookups.with_outcomes(tx_sparse(spark, sf_dir), labels), AS_OF_MS)


@query(
    "a08_device_card_profiles",
    f"WITH {SPARSE} SELECT device, card_id, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms, count(*) AS tx_count FROM tx GROUP BY 1,2",
)
def a08_device_card_profiles(spark, sf_dir):
    return analytics.device_card_profiles(tx_sparse(spark, sf_dir))


_SIGNUPS = DENSE.replace("tx AS (", "signups AS (", 1).rstrip(")") + " WHERE event_type='signup' AND 'dev' || CAST((event_id//97+user_id)%2 AS VARCHAR)='dev0')"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tx_dense(spark, sf_dir)
    registered = rows.filter((F.col("event_type") == "signup") & (F.col("device") == "dev0"))
    return tx_sparse(spark, sf_dir), registered


query(
    "j07_new_pairs",
    f"WITH {SPARSE}, {_SIGNUPS} SELECT tx_id, device, card_id FROM tx WHERE NOT EXISTS (SELECT 1 FROM signups s WHERE s.device=tx.device AND s.card_id=tx.card_id)",
)(lambda spark, sf_dir: lookups.new_pairs(*_pairs(spark, sf_dir)).select("tx_id", "device", "card_id"))
query(
    "j07_known_pairs",
    f"WITH {SPARSE}, {_SIGNUPS} SELECT tx_id, device, card_id FROM tx WHERE EXISTS (SELECT 1 FROM signups s WHERE s.device=tx.device AND s.card_id=tx.card_id)",
)(lambda spark, sf_dir: lookups.known_pairs(*_pairs(spark, sf_dir)).select("tx_id", "device", "card_id"))
for _name, _limit in (("j07_first_of_pair", 2_000_000), ("j07_first_of_pair_hot", 40)):
    query(_name, f"WITH {SPARSE} SELECT tx_id, row_number() OVER (PARTITION BY device, card_id ORDER BY ts_ms, tx_id)=1 AS is_new_pair FROM tx")(
        lambda spark, sf_dir, limit=_limit: lookups.first_of_pair(tx_sparse(spark, sf_dir), limit).select("tx_id", "is_new_pair")
    )
query("j09_cards_on_device", f"WITH {DENSE} SELECT DISTINCT device, card_id FROM tx WHERE device='dev1'")(
    lambda spark, sf_dir: lookups.cards_on_device(tx_dense(spark, sf_dir), "dev1")
)

# --- service calls -----------------------------------------------------------------------------


def calls(spark: SparkSession, sf_dir: str, service: str = "event_type") -> DataFrame:
    return tx_dense(spark, sf_dir).select(
        F.col("tx_id").alias("call_id"),
        "ts_ms",
        F.col(service).alias("service"),
        F.floor(F.col("amount") * 2).cast("long").alias("latency_ms"),
        (F.col("event_type") == "error").alias("failed"),
    )


_CALLS = DENSE + ", calls AS (SELECT tx_id AS call_id, ts_ms, {} AS service, CAST(floor(amount*2) AS BIGINT) AS latency_ms, event_type='error' AS failed FROM tx)"


@query(
    "a11_latency_percentiles",
    f"""WITH {_CALLS.format("event_type")} SELECT window_ms, service, round(p50,6) AS p50, round(p95,6) AS p95, round(p99,6) AS p99,
      p99>100 AS p99_alert, p95>50 AS p95_alert, p99>200 AS gateway_alert FROM (
      SELECT ts_ms//300000*300000 AS window_ms, service, quantile_cont(latency_ms,0.5) AS p50, quantile_cont(latency_ms,0.95) AS p95,
        quantile_cont(latency_ms,0.99) AS p99 FROM calls GROUP BY 1,2)""",
)
def a11_latency_percentiles(spark, sf_dir):
    found = monitoring.latency_percentiles(calls(spark, sf_dir), exact=True)
    return found.withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


query("a11_latency_percentiles_approximate")(lambda spark, sf_dir: monitoring.latency_percentiles(calls(spark, sf_dir)))


_HOURS_AND_DAYS = "(SELECT 3600000 AS width_ms UNION ALL SELECT 86400000)"


@query(
    "a11_merged_quantiles_within_bound",
    f"""WITH {_CALLS.format("event_type")} SELECT width_ms, ts_ms//width_ms*width_ms AS window_ms, service, count(*) AS calls,
      true AS p50_close, true AS p95_close, true AS p99_close FROM calls, {_HOURS_AND_DAYS} GROUP BY 1,2,3""",
)
def a11_merged_quantiles_within_bound(spark, sf_dir):
    """Five-minute sketches added up to hours and days: the share of calls below each value lies
    within 0.02 of the percentile asked for."""
    rows = calls(spark, sf_dir)
    sketches = monitoring.latency_sketches(rows)
    hours, days = [_merged_close(rows, sketches, width) for width in (3_600_000, 86_400_000)]
    return hours.unionByName(days)


def _merged_close(rows: DataFrame, sketches: DataFrame, width_ms: int) -> DataFrame:
    keys = ["window_ms", "service"]
    found = monitoring.merged_percentiles(sketches, width_ms)
    timed = rows.select(monitoring.window_start(F.col("ts_ms"), width_ms).alias("window_ms"), "service", "latency_ms")
    tallied = timed.groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")

    def close(name: str, p: float):
        below = F.sum(F.when(F.col("latency_ms") < F.col(name), F.col("n")).otherwise(0)) / total
        upto = F.sum(F.when(F.col("latency_ms") <= F.col(name), F.col("n")).otherwise(0)) / total
        return ((below <= p + 0.02) & (upto >= p - 0.02)).alias(f"{name}_close")

    joined = tallied.join(found, keys)
    counted = joined.groupBy(*keys, "calls").agg(close("p50", 0.5), close("p95", 0.95), close("p99", 0.99), total.alias("_n"))
    return counted.filter("calls = _n").drop("_n").withColumn("width_ms", F.lit(width_ms))


_WEEK_MS = 7 * 86_400_000


@query(
    "a07_new_cards_within_bound",
    f"""WITH {SPARSE} SELECT device, ts_ms//{_WEEK_MS} AS week, true AS cards_close, true AS new_close FROM tx GROUP BY 1,2""",
)
def a07_new_cards_within_bound(spark, sf_dir):
    """Cards on a device this week and not the week before, from daily sketches; estimates lie within
    a twentieth of the week's exact cards, or within one."""
    rows = tx_sparse(spark, sf_dir).withColumns({"day": F.expr("ts_ms div 86400000"), "week": F.expr(f"ts_ms div {_WEEK_MS}")})
    stored = analytics.card_sketches(rows, ["device", "week", "day"])
    found = analytics.new_cards(analytics.union_sketches(stored, ["device", "week"]), ["device"], "week")
    held = rows.select("device", "week", "card_id").distinct()
    before = held.select("device", (F.col("week") + 1).alias("week"), "card_id", F.lit(1).alias("known"))
    exact = held.join(before, ["device", "week", "card_id"], "left").groupBy("device", "week").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("fresh")
    )
    near = F.greatest(F.lit(1.0), F.col("n") * 0.05)
    close = lambda name, real: F.abs(F.col(name) - F.col(real)) <= near
    joined = exact.join(found, ["device", "week"])
    return joined.select("device", "week", close("cards", "n").alias("cards_close"), close("new_cards", "fresh").alias("new_close"))


_BOUNDS = monitoring.LATENCY_BOUNDS
_BUCKET = "CASE " + " ".join(f"WHEN latency_ms<={b} THEN {i}" for i, b in enumerate(_BOUNDS)) + f" ELSE {len(_BOUNDS)} END"


@query(
    "a12_histogram_quantile",
    f"""WITH {_CALLS.format("event_type")},
    b AS (SELECT service, {_BUCKET} AS bucket, count(*) AS n FROM calls GROUP BY 1,2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY service ORDER BY bucket) AS reached, 0.95::DOUBLE*sum(n) OVER (PARTITION BY service) AS rank FROM b),
    f AS (SELECT * FROM c WHERE reached>=rank QUALIFY row_number() OVER (PARTITION BY service ORDER BY bucket)=1)
    SELECT service, round(CASE WHEN bucket={len(_BOUNDS)} THEN {_BOUNDS[-1]}::DOUBLE ELSE lo + (hi-lo)*(rank-(reached-n))/n END, 6) AS quantile_ms
    FROM (SELECT *, {[0, *_BOUNDS[:-1]]}[bucket+1] AS lo, {_BOUNDS}[bucket+1] AS hi FROM f)""",
)
def a12_histogram_quantile(spark, sf_dir):
    found = monitoring.histogram_quantile(calls(spark, sf_dir), 0.95, ["service"])
    return found.withColumn("quantile_ms", F.round("quantile_ms", 6))


@query(
    "a13_throughput",
    f"""WITH {_CALLS.format("event_type")} SELECT ts_ms//60000*60000 AS window_ms, service, count(*)::DOUBLE/60.0::DOUBLE AS per_second FROM calls GROUP BY 1,2""",
)
def a13_throughput(spark, sf_dir):
    return monitoring.throughput(calls(spark, sf_dir))


@query(
    "a14_error_rate",
    f"""WITH {_CALLS.format("channel")}, r AS (SELECT ts_ms//300000*300000 AS window_ms, service, count(*) AS calls, count(*) FILTER (WHERE failed) AS failures
      FROM calls GROUP BY 1,2) SELECT *, failures::DOUBLE/calls::DOUBLE AS error_rate, failures::DOUBLE/calls::DOUBLE>0.01 AS alert FROM r""",
)
def a14_error_rate(spark, sf_dir):
    return monitoring.error_rate(calls(spark, sf_dir, "channel"))


@query(
    "a15_lag_by_group",
    """SELECT o_orderpriority AS consumer_group, o_orderstatus AS topic, CAST(sum(o_orderkey%1000) AS BIGINT) AS lag,
      CASE WHEN sum(o_orderkey%1000)>10000 THEN 'critical' ELSE 'warning' END AS severity FROM orders GROUP BY 1,2 HAVING sum(o_orderkey%1000)>5000""",
)
def a15_lag_by_group(spark, sf_dir):
    lags = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("consumer_group"), F.col("o_orderstatus").alias("topic"), (F.col("o_orderkey") % 1000).alias("lag")
    )
    return monitoring.lag_by_group(lags)


_BREAKER = f"""WITH {_CALLS.format("channel")}, w AS (SELECT call_id, service, count(*) OVER c AS window_calls,
    CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER c AS BIGINT) AS window_failures FROM calls
    WINDOW c AS (PARTITION BY service ORDER BY ts_ms, call_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT call_id, service, window_calls, window_failures, window_failures::DOUBLE/window_calls::DOUBLE AS failure_rate,
    window_calls=100 AND window_failures::DOUBLE/window_calls::DOUBLE>=0.27 AS opens FROM w"""


def _breaker(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = monitoring.breaker_state(calls(spark, sf_dir, "channel"), limit=0.27, **options)
        return state.select("call_id", "service", "window_calls", "window_failures", "failure_rate", "opens")

    return run


query("w18_failure_rate", _BREAKER)(_breaker())
query("w18_failure_rate_busy_services", _BREAKER)(_breaker(max_rows=100, block_rows=500))

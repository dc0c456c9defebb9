"""Requests, snapshots, audit rows, authentication, devices."""

import datetime
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions import requests, text
from tallyguard.operators import analytics, audit, authentication, devices, lookups, monitoring

WINDOW = 1_700_000_100_000
GOOD = ("c1", "m1", Decimal("10.0000"), "USD", "5411", "pos", None, None, "US", None)


def request_errors(spark, **changes):
    names = schemas.TRANSACTION_REQUEST.fieldNames()
    row = {**dict(zip(names, GOOD)), **changes}
    frame = spark.createDataFrame([tuple(row[n] for n in names)], schemas.TRANSACTION_REQUEST)
    return frame.select(requests.transaction_errors()).head()[0], frame


def test_request_checks(spark):
    assert request_errors(spark)[0] == []
    assert request_errors(spark, card_id="\t ")[0] == ["cardId must not be blank"]
    assert request_errors(spark, amount=None)[0] == ["amount must not be null"]
    assert request_errors(spark, amount=Decimal(0))[0] == ["amount must be positive"]
    assert request_errors(spark, currency=None)[0] == ["currency must not be blank"]
    _, frame = request_errors(spark, currency="", country="USA")
    joined = frame.select(requests.error_text(requests.transaction_errors())).head()[0]
    assert joined == (
        "country must be a 2-letter ISO code; currency must be a 3-letter ISO code; currency must not be blank"
    )


def test_request_to_event(spark):
    for channel, expected in {"pos": "POS", "Atm": "ATM", "kiosk": "ECOM"}.items():
        _, frame = request_errors(spark, channel=channel)
        event = requests.request_to_event(frame, F.lit("tx-1"), F.lit(5).cast("long")).head()
        assert event.channel == expected and event.amount == 10.0
        assert tuple(event.location) == (0.0, 0.0, "US")


def test_sortable_ids(spark):
    ids = [r[0] for r in spark.range(200).select(text.sortable_id(F.col("id") * 1000 + WINDOW)).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 200
    assert all(len(i) == 26 and set(i) <= set(text.CROCKFORD) for i in ids)


def test_typed_snapshot(spark):
    full = {
        "tx_count_1h": "3", "tx_count_6h": "7", "tx_count_24h": "15", "avg_amount_7d": "120.50", "distinct_merchants_24h": "5",
        "last_country": "US", "country_changed": "1", "time_since_last_tx_ms": "300000", "device_hash": "abc123", "velocity_score": "0.75",
    }
    frame = spark.createDataFrame([("a", full), ("b", {}), ("c", {"tx_count_1h": "x", "country_changed": "True"})], "card_id string, fields map<string,string>")
    rows = {r.card_id: tuple(r)[1:] for r in requests.typed_snapshot(frame).collect()}
    assert rows["a"] == (3, 7, 15, 120.5, 5, "US", True, 300000, "abc123", 0.75)
    assert rows["b"] == (0, 0, 0, 0.0, 0, None, False, -1, None, 0.0)
    assert rows["c"][0] == 0 and rows["c"][6] is True


def decision_frame(spark, rules=("HIGH_AMOUNT", "NEW_MERCHANT"), decision="DECLINE"):
    row = ("tx-001", "card-999", "m", 82, decision, list(rules) if rules else None, {"xgboost": 0.91, "iso_forest": 0.78} if rules else None, 45, WINDOW)
    return spark.createDataFrame([row], schemas.FRAUD_DECISION)


def test_audit_rows(spark):
    row = audit.audit_rows(decision_frame(spark)).head()
    assert (row.merchant_id, row.amount, row.applied_rules, row.latency_ms) == ("", Decimal("0.0000"), ["HIGH_AMOUNT", "NEW_MERCHANT"], 45)
    assert row.model_scores == {"xgboost": 0.91, "iso_forest": 0.78} and '"tx_id":"tx-001"' in row.raw_event
    empty = audit.audit_rows(decision_frame(spark, rules=None)).head()
    assert empty.applied_rules == [] and empty.model_scores == {}
    flat = audit.analytics_rows(audit.audit_rows(decision_frame(spark))).head()
    assert (flat.amount, flat.country, flat.channel, flat.mcc) == (0.0, "", "", "")


def test_replay_counts(spark, tmp_path):
    rows = audit.audit_rows(decision_frame(spark).unionByName(decision_frame(spark, decision="REVIEW")))
    start, end = F.timestamp_millis(F.lit(WINDOW)), F.timestamp_millis(F.lit(WINDOW))
    assert audit.replay(rows, start, end, str(tmp_path / "out")) == {"scanned": 2, "published": 2}
    assert sorted(r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["APPROVE", "DECLINE"]
    none = audit.replay(rows, F.timestamp_millis(F.lit(0)), F.timestamp_millis(F.lit(1)), str(tmp_path / "none"))
    assert none == {"scanned": 0, "published": 0}


def test_upsert_and_compaction(spark, tmp_path):
    path, packed = str(tmp_path / "t"), str(tmp_path / "packed")
    frame = lambda rows: spark.createDataFrame(rows, "tx_id string, risk_score int")
    audit.upsert_batch(frame([("a", 1), ("b", 2)]), path, 0)
    for _ in range(2):
        audit.upsert_batch(frame([("b", 3), ("c", 4)]), path, 1)
    expected = {"a": 1, "b": 3, "c": 4}
    assert {r.tx_id: r.risk_score for r in audit.current_rows(spark, path).collect()} == expected
    audit.compact(spark, path, packed)
    assert spark.read.parquet(packed).count() == 3
    audit.upsert_batch(frame([("a", 9)]), packed, 2)
    assert {r.tx_id: r.risk_score for r in audit.current_rows(spark, packed).collect()} == {**expected, "a": 9}


def test_month_table_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(1000).select(
        F.col("id").alias("tx_id"), (F.col("id") % 10).alias("card_id"), (F.lit(WINDOW) + F.col("id") * 86_400_000).alias("ts_ms")
    )
    audit.write_monthly(rows, path, files=2)
    found = audit.by_card_and_time(spark.read.parquet(path), 3, WINDOW, WINDOW + 40 * 86_400_000)
    assert sorted(r.tx_id for r in found.collect()) == [3, 13, 23, 33]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan and "EqualTo(card_id,3)" in plan


def alert_rows(spark, decisions):
    rows = [(f"t{i}", "MID-TEST-001", d, WINDOW + i * 1000) for i, d in enumerate(decisions)]
    frame = spark.createDataFrame(rows, "tx_id string, merchant_id string, decision string, ms long")
    return frame.withColumn("decided_at", F.timestamp_millis("ms"))


@pytest.mark.parametrize(
    "decisions, expected",
    [
        (["DECLINE"] * 11, [11]),
        (["DECLINE"] * 10, []),
        (["DECLINE"] * 8 + ["APPROVE"] * 5 + ["REVIEW"] * 3, []),
        (["decline"] * 12 + ["APPROVE"] * 20, [12]),
    ],
)
def test_decline_spikes(spark, decisions, expected):
    alerts = analytics.decline_spikes(alert_rows(spark, decisions))
    assert [r.decline_count for r in alerts.collect()] == expected


def test_alert_threshold_and_json(spark):
    for threshold in (0, -1):
        with pytest.raises(ValueError):
            analytics.decline_spikes(alert_rows(spark, ["DECLINE"]), threshold)
    row = analytics.spike_json(analytics.decline_spikes(alert_rows(spark, ["DECLINE"] * 11)), F.lit(WINDOW + 1)).head()
    assert row.key == "MID-TEST-001"
    assert row.value == (
        '{"alertType":"MERCHANT_DECLINE_SPIKE","merchantId":"MID-TEST-001","windowStart":"2023-11-14T22:15:00Z",'
        '"windowEnd":"2023-11-14T22:20:00Z","declineCount":11,"threshold":10,"generatedAt":"2023-11-14T22:15:00.001Z"}'
    )


def test_authentication_edges(spark):
    scores = spark.createDataFrame([("a", 300), ("b", 301), ("c", 700), ("d", 701)], "tx_id string, risk_score int")
    asked = spark.createDataFrame([(x,) for x in "abcde"], "tx_id string")
    rows = {r.tx_id: (r.risk_score, r.trans_status, r.challenge_mandated, r.flow) for r in authentication.assess(asked, scores).collect()}
    assert rows == {
        "a": (300, "Y", False, "FRICTIONLESS"), "b": (301, "C", True, "CHALLENGE"), "c": (700, "C", True, "CHALLENGE"),
        "d": (701, "R", False, "REJECTED"), "e": (850, "R", False, "REJECTED"),
    }


def test_challenges(spark):
    sessions = spark.createDataFrame([("s1", 400), ("s2", 401), ("s3", 500), ("s4", 600)], "trans_id string, risk_score int")
    results = spark.createDataFrame([("s1", "Y"), ("s2", "y"), ("s3", "N"), ("zz", "Y")], "trans_id string, result_status string")
    rows = {r.trans_id: (r.trans_status, r.eci, r.state, r.action) for r in authentication.complete_challenges(sessions, results).collect()}
    assert rows == {
        "s1": ("Y", "05", "COMPLETED", "APPROVE"), "s2": ("Y", "02", "COMPLETED", "APPROVE"), "s3": ("N", "07", "FAILED", "DECLINE"),
    }
    assert [r.trans_id for r in authentication.unknown_results(sessions, results).collect()] == ["zz"]
    states = authentication.session_states(sessions, results)
    assert authentication.active_sessions(states).head()[0] == 1


def test_replies_and_fallback(spark):
    asked = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "tx_id string, request_ms long")
    came = spark.createDataFrame(
        [("a", 1045, 10, "CHALLENGE", ["X"], 45), ("b", 1046, 10, "DECLINE", ["X"], 46)],
        "tx_id string, reply_ms long, risk_score int, decision string, applied_rules array<string>, latency_ms long",
    )
    rows = {r.request_id: tuple(r)[1:] for r in lookups.with_fallback(lookups.correlate_replies(asked, came)).collect()}
    late = (None, 0, "APPROVE", ["ASYNC_REVIEW_REQUIRED"], 0)
    assert rows == {"a": ("a", 10, "CHALLENGE", ["X"], 45), "b": late, "c": late}


def test_fingerprint_ignores_order(spark):
    one = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    two = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    row = spark.range(1).select(devices.fingerprint(one).alias("x"), devices.fingerprint(two).alias("y")).head()
    assert row.x == row.y == hashlib.sha256(b"a=1|b=2").hexdigest()
    merged = spark.range(1).select(devices.merge_signals(one, F.create_map(F.lit("a"), F.lit("9")))).head()[0]
    assert merged == {"a": "9", "b": "2"}


def test_trace_means(spark):
    frame = spark.createDataFrame(
        [([(3.0, 4.0, 0.0), (0.0, 0.0, 1.0)], [0.5, 0.25], [100, 101]), ([], [], [])],
        "s array<struct<x:double,y:double,z:double>>, p array<double>, k array<long>",
    )
    rows = frame.select(
        devices.mean_acceleration(F.col("s")), devices.mean_pressure(F.col("p")), devices.mean_interval(F.col("k"))
    ).collect()
    assert [tuple(r) for r in rows] == [("3.0000", "0.3750", "101"), ("0", "0", "0")]
    exact = spark.createDataFrame([(0.03125,), (1.00005,), (12.0,), (0.99996,)], "v double").select(text.fixed4(F.col("v")))
    assert [r[0] for r in exact.collect()] == ["0.0313", "1.0000" if 1.00005 < Decimal("1.00005") else "1.0001", "12.0000", "1.0000"]


def test_keystrokes_and_spacing(spark):
    strokes = [("s", t, i) for i, t in enumerate([0, 100, 100, 250, 5250, 5300, 10299])]
    frame = spark.createDataFrame(strokes, "session_id string, t long, seq long")
    for limit in (None, 2):
        got = devices.keystroke_intervals(frame, max_rows=limit).orderBy("t").collect()
        assert [r.interval_ms for r in got] == [100, 150, 50, 4999]
        assert [r.interval_ms for r in devices.keystroke_intervals(frame, limit=2, max_rows=limit).orderBy("t").collect()] == [50, 4999]
    points = [0, 10, 49, 50, 50, 99, 100, 130, 200, 249, 250]
    frame = spark.createDataFrame([("s", t, i) for i, t in enumerate(points)], "session_id string, t long, seq long")
    for limit in (None, 3):
        assert sorted(r.t for r in devices.downsample(frame, max_rows=limit).collect()) == [0, 50, 100, 200, 250]


def test_a_long_burst_is_walked_in_slices(spark):
    import random

    times, pick = [0], random.Random(3)
    while len(times) < 4000:
        times.append(times[-1] + pick.randint(1, 49))
    frame = spark.createDataFrame([("s", t, i) for i, t in enumerate(times)], "session_id string, t long, seq long")
    expected, last = [], None
    for t in times:
        if last is None or t - last >= 50:
            expected.append(t)
            last = t
    for options in ({"max_rows": None}, {"max_rows": 100, "slice_ms": 100}, {"max_rows": 100, "slice_ms": 7_000}):
        assert sorted(r.t for r in devices.downsample(frame, **options).collect()) == expected


def test_last_samples(spark):
    row = spark.range(1).select(
        devices.last_samples(F.sequence(F.lit(1), F.lit(5)), 3).alias("a"), devices.last_samples(F.array(F.lit(1)), 3).alias("b")
    ).head()
    assert (row.a, row.b) == ([3, 4, 5], [1])


def test_breaker_opens_at_half_of_a_full_window(spark):
    calls = spark.range(150).select(
        F.lit("s").alias("service"), F.col("id").alias("call_id"), F.col("id").alias("ts_ms"), (F.col("id") % 2 == 0).alias("failed")
    )
    for options in ({}, {"max_rows": 10, "block_rows": 120}):
        rows = monitoring.breaker_state(calls, **options).orderBy("call_id").collect()
        assert [r.opens for r in rows] == [i >= 99 for i in range(150)]
        assert rows[149].window_calls == 100 and rows[149].failure_rate == 0.5


def test_masks_and_instants(spark):
    row = spark.range(1).select(
        text.mask_card(F.lit("4111111111111111")).alias("m"), text.mask_card(F.lit("123")).alias("s"),
        text.iso_instant(F.lit(1_700_000_000_007)).alias("i"), text.json_to_map(F.lit(' {"a": "x", "n": 3} ')).alias("j"),
        text.json_to_map(F.lit("not json")).alias("bad"),
    ).head()
    assert (row.m, row.s, row.i) == ("************1111", "123", "2023-11-14T22:13:20.007Z")
    assert row.j == {"a": "x", "n": "3"} and row.bad == {}


def test_retention(spark):
    frame = spark.createDataFrame([(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 3, 31),)], "ts timestamp")
    as_of = F.lit("2024-04-01").cast("timestamp")
    assert audit.retained(frame, "transactions", as_of).count() == 1
    assert audit.retained(frame, "audit", as_of).count() == 2


def test_rows_without_a_device_are_never_new(spark):
    from tallyguard.operators.snapshots import new_device_flag

    rows = [(1, "a", 0, None), (2, "a", 10, None), (3, "a", 20, "d"), (4, "a", 20 + 86_400_000 - 1, "d"), (5, "a", 20 + 86_400_000, "d")]
    frame = spark.createDataFrame(rows, "tx_id long, card_id string, ts_ms long, device string")
    for limit in (None, 1):
        flags = {r.tx_id: r.is_new_device for r in new_device_flag(frame, limit).collect()}
        assert flags == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_copies_on_both_sides_do_not_multiply(spark):
    decided = spark.createDataFrame([("t", "APPROVE")] * 50, "tx_id string, decision string")
    sent = spark.createDataFrame([("t", "m", 1.0, "US", "POS", "5411")] * 50, "tx_id string, merchant_id string, amount double, country string, channel string, mcc string")
    assert lookups.decisions_with_transactions(decided, sent).count() == 50


def test_model_files(spark, tmp_path, monkeypatch):
    """Only a missing file means rules alone; one above the limit is an error."""
    from tallyguard.operators import model

    assert model.read_model(spark, str(tmp_path / "none.onnx")) is None
    assert model.newest_model(spark, str(tmp_path / "none")) is None
    (tmp_path / "m.onnx").write_bytes(b"x" * 100)
    assert model.newest_model(spark, str(tmp_path)) == b"x" * 100
    monkeypatch.setattr(model, "MAX_MODEL_BYTES", 99)
    with pytest.raises(ValueError):
        model.read_model(spark, str(tmp_path / "m.onnx"))


def test_lookup_reads_one_bucket(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("tx_id"), (F.col("id") % 7).alias("card_id"))
    path = str(tmp_path / "lookup")
    audit.write_by_transaction(rows, path, buckets=16)
    table = spark.read.parquet(path)
    found = audit.find_transaction(table, 777, buckets=16)
    assert [tuple(r) for r in found.collect()] == [(777, 0)]
    plan = found._jdf.queryExecution().toString()
    assert "tx_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(tx_id,777)" in plan
    assert audit.find_transaction(table, 5001, buckets=16).count() == 0
    wanted = spark.createDataFrame([(3,), (3,), (None,), (9999,), (4999,)], "tx_id long")
    assert sorted(r["tx_id"] for r in audit.find_transactions(table, wanted, buckets=16).collect()) == [3, 4999]


def test_sketches_of_new_cards(spark):
    rows = spark.createDataFrame(
        [("d", 1, 1), ("d", 1, 2), ("d", 2, 2), ("d", 2, 3), ("d", 4, 3), (None, 1, 1), (None, 2, 1), ("e", 2, None)], "device string, week long, card_id long"
    )
    found = analytics.new_cards(analytics.card_sketches(rows, ["device", "week"]), ["device"], "week")
    assert {(r["device"], r["week"]): (r["cards"], r["new_cards"]) for r in found.collect()} == {
        ("d", 1): (2, 2), ("d", 2): (2, 1), ("d", 4): (1, 1), (None, 1): (1, 1), (None, 2): (1, 0), ("e", 2): (0, 0)
    }


def test_merged_percentiles(spark):
    rows = spark.range(20_000).select((F.col("id") * 60).alias("ts_ms"), F.lit("s").alias("service"), (F.col("id") * 7919 % 20_000).alias("latency_ms"))
    stored = monitoring.latency_sketches(rows)
    assert stored.count() == 4
    day = monitoring.merged_percentiles(stored, 86_400_000).first()
    assert day["calls"] == 20_000
    assert all(abs(day[name] / 20_000 - p) < 0.02 for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    assert monitoring.merged_percentiles(monitoring.latency_sketches(rows.limit(0)), 86_400_000).count() == 0

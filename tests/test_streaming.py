"""Streams over file sources in several micro-batches."""

import json
import math
import random

import pytest
from onnx_bytes import logistic
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions import requests
from tallyguard.operators import audit
from tallyguard.operators.card_windows import COUNT_FRAMES, FEATURES, card_features
from tallyguard.operators.model import feature_vector, newest_model, onnx_probability, train_trees, with_ml_probability
from tallyguard.streaming import flows, sinks, sources
from tallyguard.streaming.card_state import _Recent, card_states, stream_card_features
from tallyguard.streaming.sessions import SessionProcessor, stream_sessions

SCHEMA = "tx_id long, card_id string, ts_ms long, amount double, merchant_id string, mcc string, channel string, country string, device string"
T0 = 1_700_000_100_000
HOUR = 3_600_000


def put(spark, folder, name, rows, schema=SCHEMA):
    """One file, so one micro-batch with ``maxFilesPerTrigger=1``."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder, schema=SCHEMA):
    shape = spark.createDataFrame([], schema).schema
    return sources.file_stream(spark, str(folder), shape, files_per_trigger=1)


def drain(stream, sink, tmp_path, name):
    query = sinks.start(stream, sink, str(tmp_path / f"{name}-checkpoint"), name, available_now=True)
    query.awaitTermination()
    return query


def tx(i, card, ts, amount=10.0, merchant="m1", country="US", device="d1"):
    return (i, card, ts, amount, merchant, "5411", "POS", country, device)


def spread(n, start=0):
    return [
        tx(i, f"c{i % 5}", T0 + i * 1_700_000, (i * 37 % 900 + 1) / 10, f"m{i * 7 % 11}", ["US", "GB", ""][i * 3 % 7 % 3], f"d{i // 9 % 2}")
        for i in range(start, start + n)
    ]


def features_of(spark, path):
    return {r["tx_id"]: tuple(r[f] for f in FEATURES) for r in spark.read.parquet(path).collect()}


def test_features_in_order_equal_batch(spark, tmp_path):
    rows = spread(240) + [tx(1000 + i, "c1", T0 + 240 * 1_700_000 + 8 * 24 * HOUR + i * 1000) for i in range(3)]
    for at in range(0, len(rows), 61):
        put(spark, tmp_path / "in", "x", rows[at : at + 61])
    out = str(tmp_path / "out")
    drain(flows.enrich(source(spark, tmp_path / "in")), sinks.table_sink(out), tmp_path, "features")
    batch = card_features(spark.createDataFrame(rows, SCHEMA), None)
    assert features_of(spark, out) == {r["tx_id"]: tuple(r[f] for f in FEATURES) for r in batch.collect()}
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 2


def test_late_and_redelivered_rows(spark, tmp_path):
    put(spark, tmp_path / "in", "1", [tx(1, "a", T0), tx(2, "a", T0 + 4000, country="GB")])
    # 3 is older than 2 but not behind the watermark; 2 comes again.
    put(spark, tmp_path / "in", "2", [tx(3, "a", T0 + 2000, merchant="m2"), tx(2, "a", T0 + 4000, country="GB"), tx(4, "a", T0 + 60_000, country="GB")])
    # Rows are held against the watermark of the batch before: 5 is behind it in the fourth.
    put(spark, tmp_path / "in", "3", [tx(6, "a", T0 + 61_000, country="GB")])
    put(spark, tmp_path / "in", "4", [tx(5, "a", T0 + 1000)])
    out = str(tmp_path / "out")
    drain(flows.enrich(source(spark, tmp_path / "in")), sinks.table_sink(out), tmp_path, "late")
    found = features_of(spark, out)
    assert set(found) == {1, 2, 3, 4, 6}
    assert found[3][0] == 2  # counted at its own time: 1 and 3
    assert found[4][0] == 4 and not found[4][5]  # last country is still that of 2
    assert found[6][0] == 5


def test_state_is_freed_after_a_week(spark, tmp_path):
    day = 24 * HOUR
    put(spark, tmp_path / "in", "1", [tx(1, "a", T0), tx(2, "b", T0)])
    put(spark, tmp_path / "in", "2", [tx(3, "b", T0 + 5 * day)])
    put(spark, tmp_path / "in", "3", [tx(4, "c", T0 + 9 * day)])
    put(spark, tmp_path / "in", "4", [tx(5, "c", T0 + 9 * day + 1)])
    out = str(tmp_path / "out")
    query = drain(stream_card_features(sources.with_event_time(source(spark, tmp_path / "in"))), sinks.table_sink(out), tmp_path, "ttl")
    removed = sum(
        p["stateOperators"][0]["customMetrics"].get("numValueStateVars", 0) and p["stateOperators"][0].get("numRowsRemoved", 0)
        for p in map(lambda p: json.loads(p.json), query.recentProgress)
    )
    assert len(features_of(spark, out)) == 5 and removed >= 1


def test_hot_card_goes_over_many_merchants(spark, tmp_path, monkeypatch):
    from tallyguard.streaming import card_state

    monkeypatch.setattr(card_state, "_MERCHANTS_INLINE", 3)
    state = {}

    class Map:
        def containsKey(self, key):
            return key in state

        def updateValue(self, key, value):
            state[key] = value

        def clear(self):
            state.clear()

    processor = card_state.CardFeatureProcessor()
    processor.merchants = Map()
    inline, spilled = set(), 0
    for seller in ["a", "b", "c", "d", "e", "d", "a", "f"]:
        if seller not in inline:
            spilled += processor._remember(inline, seller, spilled)
    assert len(inline) + spilled == 6
    assert processor._forget(spilled) == 0 and not state


def test_alerts_drop_late_rows_and_close_windows(spark, tmp_path):
    schema = "tx_id string, merchant_id string, decision string, risk_score int, decision_ms long"
    row = lambda i, ms, d="DECLINE": (f"t{i}", "MID-TEST-001", d, 800, ms)
    put(spark, tmp_path / "in", "1", [row(i, T0 + i * 1000) for i in range(10)], schema)
    put(spark, tmp_path / "in", "2", [row(10, T0 + 200_000)], schema)
    put(spark, tmp_path / "in", "3", [row(11, T0 + 311_000, "APPROVE")], schema)  # closes the window
    put(spark, tmp_path / "in", "4", [row(13, T0 + 312_000, "APPROVE")], schema)
    put(spark, tmp_path / "in", "5", [row(12, T0 + 5_000), row(14, T0 + 313_000, "APPROVE")], schema)  # 12 is too late
    out = tmp_path / "alerts"
    query = sinks.append_files(
        flows.decline_alert_records(source(spark, tmp_path / "in", schema)), str(out), str(tmp_path / "c"), "alerts", "json", True
    )
    query.awaitTermination()
    alerts = [json.loads(r.value) for r in spark.read.schema("key string, value string").json(str(out)).collect()]
    assert [(a["merchantId"], a["declineCount"], a["windowStart"]) for a in alerts] == [("MID-TEST-001", 11, "2023-11-14T22:15:00Z")]
    with pytest.raises(ValueError):
        flows.decline_alerts(source(spark, tmp_path / "in", schema), 0)


def test_sessions(spark, tmp_path):
    put(spark, tmp_path / "open", "1", [("s1", 400), ("s2", 401), ("s3", 2)], "trans_id string, risk_score int")
    put(spark, tmp_path / "done", "1", [("s1", "y"), ("s2", "N"), ("zz", "Y")], "trans_id string, result_status string")
    stream = stream_sessions(
        source(spark, tmp_path / "open", "trans_id string, risk_score int"),
        source(spark, tmp_path / "done", "trans_id string, result_status string"),
    )
    drain(stream, sinks.table_sink(str(tmp_path / "out")), tmp_path, "sessions")
    found = {(r.trans_id, r.state, r.trans_status, r.eci) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {
        ("s1", "PENDING", None, None), ("s2", "PENDING", None, None), ("s3", "PENDING", None, None),
        ("s1", "COMPLETED", "Y", "05"), ("s2", "FAILED", "N", "07"), ("zz", "NOT_FOUND", None, None),
    }


def test_dead_letters_and_retry(spark, tmp_path):
    names = schemas.TRANSACTION_REQUEST
    from decimal import Decimal

    good = ("c1", "m1", Decimal("10"), "USD", "5411", "pos", None, None, "US", None)
    bad = ("", "m1", Decimal("-1"), "USD", "5411", "pos", None, None, "US", None)
    spark.createDataFrame([good, bad], names).coalesce(1).write.parquet(str(tmp_path / "in"))
    ok, dead = str(tmp_path / "ok"), str(tmp_path / "dead")
    sink = sinks.dead_letter_sink(sinks.table_sink(ok), sinks.table_sink(dead), requests.transaction_errors(), "scoring-realtime")
    drain(sources.file_stream(spark, str(tmp_path / "in"), names), sink, tmp_path, "dlq")
    assert spark.read.parquet(ok).count() == 1
    letter = spark.read.parquet(dead).head()
    assert letter.failure_reason == "amount must be positive; cardId must not be blank"
    assert (letter.original_topic, letter.consumer_group, letter.attempt_count) == ("transactions.raw", "scoring-realtime", 3)
    sink(spark.createDataFrame([good, bad], names), 0)  # the batch runs again after a failure
    assert spark.read.parquet(ok).count() == 1 and spark.read.parquet(dead).count() == 1


def test_replies_on_a_stream(spark, tmp_path):
    asked, came = "tx_id string, request_ms long", "tx_id string, reply_ms long, risk_score int"
    put(spark, tmp_path / "q", "1", [("a", T0), ("b", T0), ("c", T0)], asked)
    put(spark, tmp_path / "r", "1", [("a", T0 + 45, 1), ("b", T0 + 46, 2)], came)
    put(spark, tmp_path / "q", "2", [("z", T0 + 60_000)], asked)
    put(spark, tmp_path / "r", "2", [("y", T0 + 60_000, 3)], came)
    joined = flows.correlate_replies(source(spark, tmp_path / "q", asked), source(spark, tmp_path / "r", came))
    drain(joined, sinks.table_sink(str(tmp_path / "out")), tmp_path, "replies")
    rows = {r.tx_id: (r.timed_out, r.risk_score) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"a": (False, 1), "b": (True, None), "c": (True, None)}


def test_first_reply_counts_whichever_batch_it_comes_in(spark, tmp_path):
    asked, came = "tx_id string, request_ms long, card string", "tx_id string, reply_ms long, risk_score int"
    put(spark, tmp_path / "q", "1", [("a", T0, "c1"), ("a", T0, "c1"), ("b", T0 + 3, None), ("c", T0, "c3")], asked)
    put(spark, tmp_path / "r", "1", [("a", T0 + 30, 1), ("a", T0 + 10, 2), ("b", T0 + 2, 3), ("late", T0, 4)], came)
    put(spark, tmp_path / "q", "2", [("late", T0 - 1, "c4"), ("a", T0 + 20, "c1")], asked)
    put(spark, tmp_path / "r", "2", [("c", T0 + 45, 5), ("a", T0 + 10, 2), ("b", T0 + 49, 6)], came)
    put(spark, tmp_path / "q", "3", [("z", T0 + 60_000, "c")], asked)
    put(spark, tmp_path / "r", "3", [("y", T0 + 60_000, 7)], came)
    joined = flows.correlate_replies(source(spark, tmp_path / "q", asked), source(spark, tmp_path / "r", came))
    drain(joined, sinks.table_sink(str(tmp_path / "out")), tmp_path, "first-reply")
    rows = sorted((r.tx_id, r.request_ms - T0, r.card, r.timed_out, r.risk_score) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [
        ("a", 0, "c1", False, 2), ("a", 20, "c1", False, 1), ("b", 3, None, True, None), ("c", 0, "c3", False, 5), ("late", -1, "c4", False, 4),
    ]


def test_replies_need_no_call_per_row(spark, tmp_path):
    """All pairs of random requests and replies over three micro-batches, copies and null ids among
    them; the work stays in Spark's own aggregation, without a Python call for each row of state."""
    rng = random.Random(3)
    asked, came = "tx_id string, request_ms long", "tx_id string, reply_ms long, risk_score int, model_scores map<string,double>"
    ids = [None, "a", "b", "c"]
    requests = [(rng.choice(ids), T0 + rng.randrange(1500)) for _ in range(60)]
    replies = [(rng.choice(ids), T0 + rng.randrange(1500)) for _ in range(60)]
    replies = [(i, ms, ms % 97, {"m": 0.5} if ms % 2 else None) for i, ms in replies]
    for part in range(3):
        put(spark, tmp_path / "q", str(part), requests[part::3] + requests[:5], asked)
        put(spark, tmp_path / "r", str(part), replies[part::3] + replies[:5], came)
    put(spark, tmp_path / "q", "far", [("far", T0 + 60_000)], asked)
    put(spark, tmp_path / "r", "far", [("far", T0 + 50_000, 0, None)], came)
    put(spark, tmp_path / "q", "end", [("end", T0 + 90_000)], asked)
    put(spark, tmp_path / "r", "end", [("end", T0 + 90_000, 0, None)], came)
    joined = flows.correlate_replies(source(spark, tmp_path / "q", asked), source(spark, tmp_path / "r", came))
    assert "TransformWithState" not in joined._jdf.queryExecution().analyzed().toString()
    drain(joined, sinks.table_sink(str(tmp_path / "out")), tmp_path, "many-replies")
    rows = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.tx_id not in ("far", "end")]
    expected = {}
    for i, ms in requests:
        in_time = sorted(r[1:3] for r in replies if r[0] == i and ms <= r[1] <= ms + 45)
        expected[i, ms] = (False, *in_time[0]) if in_time else (True, None, None)
    assert {(r.tx_id, r.request_ms): (r.timed_out, r.reply_ms, r.risk_score) for r in rows} == expected
    assert len(rows) == len(expected)
    assert all(r.model_scores == ({"m": 0.5} if r.reply_ms is not None and r.reply_ms % 2 else None) for r in rows)


def test_reply_route_and_audit(spark, tmp_path):
    row = lambda i, topic: (f"t{i}", "c", "m", 10, "APPROVE", ["X"], {"rule.X": 1.0}, 3, T0, topic)
    from pyspark.sql import types as T

    schema = T.StructType([*schemas.FRAUD_DECISION.fields, T.StructField("reply_topic", T.StringType())])
    spark.createDataFrame([row(1, "r-7"), row(2, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sources.file_stream(spark, str(tmp_path / "in"), schema)
    sink = sinks.decisions_with_reply(sinks.table_sink(str(tmp_path / "all")), sinks.table_sink(str(tmp_path / "replies")))
    drain(stream, sink, tmp_path, "route")
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    assert [(r.tx_id, r.topic) for r in spark.read.parquet(str(tmp_path / "replies")).collect()] == [("t1", "r-7")]
    both = sinks.audit_sink(str(tmp_path / "audit"), str(tmp_path / "flat"))
    drain(stream.drop("reply_topic"), both, tmp_path, "audit")
    assert audit.current_rows(spark, str(tmp_path / "audit")).count() == 2
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 2


def test_audit_sink_evaluates_a_batch_once_and_holds_none_of_it(spark, tmp_path, monkeypatch):
    rows = [(f"t{i}", "c", "m", 10, "APPROVE", ["X"], {"rule.X": 1.0}, 3, T0 + i) for i in range(50)]
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda tx_id: read.add(1) or tx_id)
    batch = spark.createDataFrame(rows, schemas.FRAUD_DECISION).withColumn("tx_id", counted("tx_id"))

    def held(*_):
        raise AssertionError("the whole micro-batch would be held")

    monkeypatch.setattr(type(batch), "persist", held)
    sink = sinks.audit_sink(str(tmp_path / "audit"), str(tmp_path / "flat"), "w=1")
    sink(batch, 7)
    assert read.value == 50
    sink(batch, 7)
    sink(batch.filter("tx_id = 'none'"), 8)
    for table in ("audit", "flat"):
        found = spark.read.parquet(str(tmp_path / table))
        assert found.count() == 50 and audit.current_rows(spark, str(tmp_path / table)).count() == 50
    named = audit.current_rows(spark, str(tmp_path / "audit"), columns=["decision"])
    assert named.columns == ["tx_id", "decision"] and named.count() == 50


class Counted:
    """A value or map state that counts its accesses."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]


def test_sessions_of_a_bucket_cost_two_accesses():
    processor = SessionProcessor()
    state = Counted()
    processor.init(type("Handle", (), {"getValueState": lambda *_: state}))
    row = Row("trans_id", "risk_score", "result_status", "result_ms")
    opened = [row(f"s{i}", i, None, None) for i in range(100)] + [row(None, 1, None, None)]
    first = list(processor.handleInputRows((1,), iter([*[row(f"s{i}", None, "Y", 2) for i in range(0, 120)], *opened]), None))
    assert state.calls == 2 and len(first) == 221
    assert {r.trans_id for r in first if r.state == "NOT_FOUND"} == {f"s{i}" for i in range(100, 120)}
    later = list(processor.handleInputRows((1,), iter([row("s3", None, "N", 1), row("s4", None, "N", 3), row(None, None, "N", None)]), None))
    assert [tuple(r) for r in sorted(later, key=lambda r: str(r.trans_id))] == [(None, "FAILED", "N", "07"), ("s4", "FAILED", "N", "07")]
    assert list(processor.handleInputRows((1,), iter([row("s4", None, "Y", 2)]), None)) == []
    assert state.calls == 5


def test_hours_of_a_card_stay_with_it_while_they_are_small():
    state, sizes, near = Counted(), {}, ()
    rows = random.Random(5).choices(range(0, 48 * HOUR, 60_000), k=300)
    recent = _Recent(state, sizes, near)
    for at in rows:
        recent.add(at, "m")
    near = recent.save(-1)
    assert state.calls == 0 and near[0] == sorted(set(rows))
    busy = [50 * HOUR + i for i in range(900)]
    recent = _Recent(state, sizes, zip(*near))
    for at in busy:
        recent.add(at, "m")
    near = recent.save(-1)
    assert near == ([], []) and sum(len(ts) for ts, _ in state.map.values()) == len(set(rows)) + 900
    recent = _Recent(state, sizes, zip(*near))
    recent.add(51 * HOUR, "m")
    expected = sorted({*rows, *busy, 51 * HOUR})
    assert recent.counts([51 * HOUR])[0] == tuple(sum(t >= 51 * HOUR - o for t in expected) for o in COUNT_FRAMES.values())
    recent.save(51 * HOUR)
    assert state.map == {} and set(sizes) == {51}


def test_busy_card_over_batches(spark, tmp_path):
    """More rows a day than a card holds inline, in three micro-batches."""
    rows = [tx(i, f"c{i % 2}", T0 + i * 40_000, merchant=f"m{i % 7}") for i in range(2400)]
    for part in range(3):
        put(spark, tmp_path / "in", str(part), rows[part * 800 : (part + 1) * 800])
    out = str(tmp_path / "out")
    drain(flows.enrich(source(spark, tmp_path / "in")), sinks.table_sink(out), tmp_path, "busy")
    batch = card_features(spark.createDataFrame(rows, SCHEMA), None)
    assert features_of(spark, out) == {r["tx_id"]: tuple(r[f] for f in FEATURES) for r in batch.collect()}


def test_two_queries_in_one_session(spark, tmp_path):
    put(spark, tmp_path / "in", "1", spread(20))
    schema = "tx_id string, merchant_id string, decision string, risk_score int, decision_ms long"
    put(spark, tmp_path / "decisions", "1", [(f"t{i}", "m", "DECLINE", 800, T0 + i) for i in range(11)], schema)
    put(spark, tmp_path / "decisions", "2", [("z", "m", "APPROVE", 0, T0 + 400_000)], schema)
    paths = flows.AppPaths(*[str(tmp_path / p) for p in ("enriched", "features", "alerts", "checkpoints")])
    queries = flows.start_app(spark, source(spark, tmp_path / "in"), source(spark, tmp_path / "decisions", schema), paths, available_now=True)
    for query in queries:
        query.awaitTermination()
    assert [q.name for q in queries] == ["transaction-enrichment", "fraud-alerts"]
    assert spark.read.parquet(paths.enriched).count() == spark.read.parquet(paths.features).count() == 20
    assert spark.read.schema("key string, value string").json(paths.alerts).count() == 1


def test_start_positions():
    assert [sources.start_position(c) for c in ("scoring-realtime", "audit-writer", "flink-enrichment", "fraud-alerts")] == [
        "earliest", "earliest", "latest", "latest",
    ]


# --- model -------------------------------------------------------------------------------------

WEIGHTS = [0.01, -0.02, 0.3, 0.0, 0.0, 0.1, 0.5, 1.0, -0.05]


def enriched(spark, n=40):
    return card_features(spark.createDataFrame(spread(n), SCHEMA), None)


def expected(row, bias):
    x = [row.amount, row.avg_amount_7d, row.tx_count_1h, row.tx_count_6h, row.tx_count_24h, row.distinct_merchants_24h,
         row.velocity_score, float(row.country_changed), row.time_since_last_tx_ms / HOUR]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, WEIGHTS)) + bias)))


@pytest.mark.parametrize("width", [1, 2])
def test_onnx_probability(spark, width):
    pytest.importorskip("onnxruntime")
    rows = enriched(spark).withColumn("p", onnx_probability(spark, logistic(WEIGHTS, 0.2, width), feature_vector())).collect()
    assert all(abs(r.p - expected(r, 0.2)) < 1e-5 for r in rows)


def test_missing_or_broken_model_gives_null(spark):
    for model in (None, b"not a model", logistic([1.0, 2.0], 0.0)):
        rows = enriched(spark, 5).withColumn("p", onnx_probability(spark, model, feature_vector())).collect()
        assert all(r.p is None for r in rows)


def test_model_is_swapped_between_batches(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    models, out = tmp_path / "models", str(tmp_path / "out")
    sink = flows.scoring_sink(sinks.table_sink(out), str(models))
    batch = enriched(spark, 10)
    sink(batch, 0)
    models.mkdir()
    (models / "v1.onnx").write_bytes(logistic([0.0] * 9, 0.0))
    sink(batch, 1)
    (models / "v2.onnx").write_bytes(logistic([0.0] * 9, 20.0))
    sink(batch, 2)
    found = {r.batch_id: r.p for r in spark.read.parquet(out).groupBy("batch_id").agg(F.max(F.col("model_scores")["ml.onnx"]).alias("p")).collect()}
    assert found[0] is None and found[1] == 0.5 and found[2] > 0.99
    assert newest_model(spark, str(tmp_path / "none")) is None


def test_trained_trees(spark):
    rows = enriched(spark, 200)
    labelled = rows.withColumn("is_confirmed_fraud", F.when(F.col("tx_id") % 3 != 0, (F.col("amount") > 45).cast("int")))
    scored = with_ml_probability(rows, train_trees(labelled, rounds=3), "p")
    low, high = (scored.filter(c).agg(F.avg("p")).head()[0] for c in ("amount <= 45", "amount > 45"))
    assert scored.columns == [*rows.columns, "p"] and low < 0.3 < 0.7 < high
    assert with_ml_probability(rows, None).filter("p is not null").count() == 0


def test_stream_starts_from_a_table(spark, tmp_path):
    """Cards with more merchants than are held inline, with gaps of a day and a week, idle at the cut, and unknown before it."""
    cut = T0 + 30 * 24 * HOUR
    many = [tx(i, "many", cut - 20 * HOUR + i * 1000, merchant=f"m{i}") for i in range(1100)]
    gaps = [tx(2000 + i, "gaps", T0 + at * HOUR, amount=i + 1.0, merchant=f"m{i % 3}") for i, at in enumerate([0, 1, 30, 300, 330, 700, 701])]
    past = [*many, *gaps, tx(3000, "idle", T0), tx(3001, None, cut - 1000, country="GB", device=None)]
    coming = [
        *[tx(4000 + i, "many", cut + i * 1000, merchant=f"m{i * 400}") for i in range(5)],
        *[tx(4100 + i, card, cut + 1000 + i, country=None, merchant="m1") for i, card in enumerate(["gaps", "idle", "new", None])],
        tx(4200, "gaps", cut + 40 * HOUR, merchant="m9"),
    ]
    put(spark, tmp_path / "in", "1", coming)
    states = card_states(spark.createDataFrame(past, SCHEMA), cut)
    assert states.filter("part = 'head'").count() == 3  # the idle card starts afresh
    assert states.filter("part = 'merchant'").count() == 100
    out = str(tmp_path / "out")
    drain(flows.enrich(source(spark, tmp_path / "in"), states), sinks.table_sink(out), tmp_path, "from-table")
    batch = card_features(spark.createDataFrame(past + coming, SCHEMA), None).filter("tx_id >= 4000")
    assert features_of(spark, out) == {r["tx_id"]: tuple(r[f] for f in FEATURES) for r in batch.collect()}


def test_stream_starts_from_an_empty_table(spark, tmp_path):
    put(spark, tmp_path / "in", "1", spread(20))
    states = card_states(spark.createDataFrame([], SCHEMA), T0)
    assert states.count() == 0
    out = str(tmp_path / "out")
    drain(flows.enrich(source(spark, tmp_path / "in"), states), sinks.table_sink(out), tmp_path, "from-nothing")
    batch = card_features(spark.createDataFrame(spread(20), SCHEMA), None)
    assert features_of(spark, out) == {r["tx_id"]: tuple(r[f] for f in FEATURES) for r in batch.collect()}


def test_month_table_of_a_stream_is_sorted(spark, tmp_path):
    """Each file of a batch holds a range of cards in order, also where one card has most rows."""
    rows = [tx(i, "hot" if i % 3 else f"c{i:05d}", T0 + (i * 7919 % 5000) * 1000) for i in range(3000)]
    table = str(tmp_path / "months")
    sinks.month_sink(table)(spark.createDataFrame(rows, SCHEMA).repartition(4), 0)
    sinks.month_sink(table)(spark.createDataFrame(rows, SCHEMA).repartition(4), 0)  # the batch again
    files = {r[0] for r in spark.read.parquet(table).select(F.input_file_name()).distinct().collect()}
    held = []
    for file in files:
        found = [(r["card_id"], r["ts_ms"], r["tx_id"]) for r in spark.read.parquet(file).collect()]
        assert found == sorted(found)
        held.append((found[0], found[-1], len(found)))
    held.sort()
    assert all(a[1] < b[0] for a, b in zip(held, held[1:]))
    assert sum(n for *_, n in held) == 3000

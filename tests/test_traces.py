"""Traces of a user and hour with more samples than one trace keeps."""

import re

from pyspark.sql import functions as F

from tallyguard.operators import devices
from tallyguard.plans import device_queries


def test_each_trace_has_its_own_limit(spark, monkeypatch):
    """Of 1000 samples every fifth is a touch; another user touches only long before the newest 200."""
    ids = spark.range(1000).withColumnRenamed("id", "tx_id")
    touched = {1: F.col("tx_id") % 5 == 0, 2: F.col("tx_id") < 60}
    rows = [ids.withColumns({"card_id": F.lit(c), "k": F.when(t, 50 + F.col("tx_id") % 50).otherwise(1)}) for c, t in touched.items()]
    tx = rows[0].unionByName(rows[1]).withColumns({"ts_ms": F.lit(7_200_000).cast("long"), "amount": F.lit(1.0)})
    monkeypatch.setattr(device_queries, "tx_dense", lambda spark, sf_dir: tx)
    monkeypatch.setattr(device_queries, "props_k", lambda: F.col("k"))

    counts = {r.card_id: r.signals for r in device_queries.f03_trace_counts(spark, "").collect()}
    touches = {card: int(re.search(r"touchEvents=(\d+)", text)[1]) for card, text in counts.items()}
    assert touches == {1: 200, 2: 60}
    assert all("keystrokeIntervals=100|" in text and "mouseMovements=200|" in text for text in counts.values())

    traces = {r.card_id: r for r in device_queries.payloads(spark, "").collect()}
    assert [len(traces[1].mouse), len(traces[1].samples), len(traces[1].pressures)] == [200, 100, 50]
    assert traces[1].strokes == traces[2].strokes == list(range(900, 1000))
    assert traces[2].pressures == [(50 + i % 50) / 99 for i in range(10, 60)]


def test_a_release_counts_after_a_press_only(spark):
    events = [(0, True), (30, False), (50, True), (60, True), (100, False), (120, False), (130, None), (140, True)]
    rows = [(s, t, i, p) for s in ("a", None) for i, (t, p) in enumerate(events)] + [("b", 5, 0, False)]
    frame = spark.createDataFrame(rows, "session_id string, t long, seq long, pressed boolean")
    expected = [("a", 30, 30), ("a", 100, 40), ("", 30, 30), ("", 100, 40)]
    for limit in (None, 2):
        held = devices.key_holds(frame, max_rows=limit).collect()
        assert sorted((r.session_id or "", r.t, r.hold_ms) for r in held) == sorted(expected)
    assert [r.t for r in devices.key_holds(frame.filter("session_id = 'a'"), limit=1).collect()] == [100]


def test_mobile_map_without_samples(spark):
    row = spark.sql("SELECT array() AS none, CAST(array() AS array<double>) AS p, CAST(array() AS array<struct<x:double,y:double,z:double>>) AS s, CAST(array() AS array<bigint>) AS i")
    signals = row.select(devices.mobile_signals(F.col("s"), F.col("p"), F.col("i")).alias("m")).first().m
    assert len(signals) == 6 and set(signals.values()) == {"0"}

"""Tier edges of the rules, sums, fusion and decisions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyguard.operators.rules import DEFAULT_RULES, Rule, _isolated, python_rule, with_rule_scores
from tallyguard.operators.scoring import ScoringOptions, decision, fused_score, risk_band, score_transactions

HOUR = 3_600_000
TEN_O_CLOCK = 1_705_312_800_000  # 2024-01-15 10:00 UTC
BASE = dict(
    tx_id="tx-test-default", card_id="card-001", merchant_id="merchant-001", amount=100.0, avg_amount_7d=100.0, mcc="5411",
    device=None, device_hash=None, ts_ms=TEN_O_CLOCK, tx_count_1h=1, tx_count_6h=3, tx_count_24h=5, distinct_merchants_24h=2,
    country_changed=False, time_since_last_tx_ms=HOUR, velocity_score=0.0,
)
SCHEMA = (
    "tx_id string, card_id string, merchant_id string, amount double, avg_amount_7d double, mcc string, device string, "
    "device_hash string, ts_ms long, tx_count_1h long, tx_count_6h long, tx_count_24h long, distinct_merchants_24h long, "
    "country_changed boolean, time_since_last_tx_ms long, velocity_score double"
)
HIGH = dict(
    amount=1000.0, tx_count_1h=15, country_changed=True, time_since_last_tx_ms=1_800_000, mcc="7995", device="fp-new-device",
    device_hash="fp-old-device", ts_ms=TEN_O_CLOCK - 7 * HOUR,
)


def frame(spark, *changes):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**BASE, **c}[n] for n in names) for c in changes], SCHEMA)


def scores(spark, column, *changes):
    return [r[column] for r in with_rule_scores(frame(spark, *changes)).collect()]


def test_velocity(spark):
    assert scores(spark, "rule_velocity", *[dict(tx_count_1h=n) for n in (5, 6, 7, 10, 11)]) == [0, 15, 15, 15, 30]


def test_amount(spark):
    cases = [(200.0, 100.0), (200.01, 100.0), (300.0, 100.0), (300.01, 100.0), (500.0, 0.0), (500.0, -1.0)]
    assert scores(spark, "rule_amount_anomaly", *[dict(amount=a, avg_amount_7d=v) for a, v in cases]) == [0, 10, 10, 25, 0, 0]


def test_geo(spark):
    cases = [(True, HOUR), (True, HOUR - 1), (True, 900_000), (True, 7_200_000), (False, 900_000)]
    got = scores(spark, "rule_geo_anomaly", *[dict(country_changed=c, time_since_last_tx_ms=t) for c, t in cases])
    assert got == [15, 40, 40, 15, 0]


def test_category_device_time(spark):
    codes = ["7995", "5967", "5912", "5122", "5411", None]
    assert scores(spark, "rule_merchant_category", *[dict(mcc=c) for c in codes]) == [15, 15, 15, 15, 0, 0]
    pairs = [("a", "b"), ("a", "a"), (None, "b"), ("a", None)]
    assert scores(spark, "rule_device_change", *[dict(device=a, device_hash=b) for a, b in pairs]) == [20, 0, 0, 0]
    hours = [dict(ts_ms=TEN_O_CLOCK + (h - 10) * HOUR) for h in range(8)]
    assert scores(spark, "rule_time_anomaly", *hours) == [0, 10, 10, 10, 10, 10, 0, 0]


def test_low_and_high_risk(spark):
    low = dict(amount=50.0, avg_amount_7d=60.0, tx_count_1h=2, time_since_last_tx_ms=7_200_000, device="fp-abc123", device_hash="fp-abc123")
    rows = score_transactions(frame(spark, low, HIGH)).orderBy("rule_score").collect()
    assert [(r.rule_score, r.risk_score, r.decision) for r in rows] == [(0, 0, "APPROVE"), (140, 1000, "DECLINE")]
    assert rows[1].applied_rules == [r.name for r in DEFAULT_RULES]
    assert rows[0].applied_rules == []
    assert set(rows[0].rule_scores) == {r.name for r in DEFAULT_RULES}


def test_fusion_and_thresholds(spark):
    cases = [(70, 0.5, 500), (42, 0.55, 450), (140, 1.0, 1000), (42, None, 300), (98, None, 700), (0, None, 0)]
    rows = spark.createDataFrame(cases, "rule int, p double, expected int").withColumn("got", fused_score(F.col("rule"), F.col("p")))
    assert all(r.got == r.expected for r in rows.collect())
    edges = spark.createDataFrame([(300,), (301,), (699,), (700,)], "s int").select(decision(F.col("s")).alias("d"))
    assert [r.d for r in edges.collect()] == ["APPROVE", "CHALLENGE", "CHALLENGE", "DECLINE"]
    moved = ScoringOptions(approve_up_to=100, decline_from=200)
    assert spark.range(1).select(decision(F.lit(150), moved)).head()[0] == "CHALLENGE"


def test_rounding_follows_the_nearest_integer(spark):
    half = 0.49999999999999994
    rows = spark.createDataFrame([(half / 1000,), (0.0005,)], "p double").select(
        fused_score(F.lit(0), F.col("p"), ScoringOptions(model_weight=1.0)).alias("s")
    )
    assert [r.s for r in rows.collect()] == [0, 1]


def test_risk_bands(spark):
    rows = spark.createDataFrame([(s,) for s in (299, 300, 599, 600, 850, 851)], "s int").select(risk_band(F.col("s")).alias("b"))
    assert [r.b for r in rows.collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_score_map(spark):
    rows = frame(spark, HIGH).withColumn("p", F.lit(0.25))
    found = score_transactions(rows, "p").head()
    assert found.model_scores["rule.GEO_ANOMALY"] == 40.0 and found.model_scores["ml.onnx"] == 0.25
    assert not found.fallback_used
    bare = score_transactions(frame(spark, HIGH)).head()
    assert "ml.onnx" not in bare.model_scores and len(bare.model_scores) == 6 and bare.fallback_used


def test_failing_rules_are_left_out(spark):
    broken = Rule("BROKEN", lambda: F.when(F.try_divide(F.lit(1), F.col("tx_count_1h") - 1).isNotNull(), 7))

    def raises(batch):
        if (batch["amount"] > 500).any():
            raise RuntimeError("no")
        return batch["amount"] * 0 + 3

    rules = [DEFAULT_RULES[0], broken, python_rule("PANDAS", ["amount"], raises)]
    first, second = with_rule_scores(frame(spark, {}, HIGH), rules).orderBy("amount").collect()
    assert first.rule_scores == {"VELOCITY": 0, "PANDAS": 3} and first.rule_score == 3
    assert second.rule_scores == {"VELOCITY": 30, "BROKEN": 7} and second.rule_score == 37
    assert second.applied_rules == ["VELOCITY", "BROKEN"]


def test_pandas_rule_tries_equal_rows_once():
    calls = []

    def score(batch):
        calls.append(len(batch))
        if (np.signbit(batch["a"]) & (batch["a"] == 0)).any() or (batch["b"] == "x").any():
            raise ValueError("no score")
        return batch["a"] * 0 + 4

    a = [0.0, -0.0, 1.0, float("nan"), 2.0] * 2000
    batch = pd.DataFrame({"a": a, "b": (["x"] + ["y"] * 6 + [None]) * 1250})
    found = _isolated(score, batch)
    assert len(calls) < 100
    expected = [None if b == "x" or np.signbit(x) and x == 0 or np.isnan(x) else 4 for x, b in zip(a, batch["b"])]
    assert [None if v is pd.NA else v for v in found] == expected
    lists = pd.DataFrame({"a": [1.0, -0.0, 2.0], "b": [["y"], ["y"], ["z"]]})
    assert [v is pd.NA for v in _isolated(score, lists)] == [False, True, False]
    with pytest.raises(ValueError, match="scores for"):
        _isolated(lambda frame: pd.Series([1]), lists)


def test_no_rules_and_duplicate_names(spark):
    none = with_rule_scores(frame(spark, {}), []).head()
    assert (none.rule_score, none.applied_rules, none.rule_scores) == (0, [], {})
    with pytest.raises(ValueError):
        with_rule_scores(frame(spark, {}), [DEFAULT_RULES[0], DEFAULT_RULES[0]])

"""Registered queries next to their SQL; CHECK_ALL=1 runs every one."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, connect  # noqa: E402

DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "card_features_dense",
    "card_features_hot_cards",
    "card_features_null_keys_hot",
    "w04_four_decimals",
    "w16_fraud_rate_spike_by_channel",
    "w17_sustained_alert_by_channel",
    "j03_two_replies",
    "j05_newest_outcome",
    "j07_first_of_pair_hot",
    "f05_mean_pressure",
    "o03_lifecycle_total",
    "s08_fresh_checkpoint_keeps_history",
    "s08_two_states_in_one_batch",
    "s17_dead_letters_again",
    "w06_strict_week_hot_cards",
    "w12_snapshots_as_of",
    "w13_new_merchant_hot_pairs",
    "w18_failure_rate_busy_services",
    "w21_min_spacing_hot_sessions",
    "j01_as_of_snapshot_hot_cards",
    "j04_fallback_response",
    "r12_decision_rows",
    "a07_device_profiles",
    "a11_latency_percentiles",
    "a12_histogram_quantile",
    "o03_lifecycle_paged",
    "p02_error_text",
    "s08_audit_upsert",
    "s17_dead_letter_replay",
    "u03_final_decisions",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("CHECK_ALL") else SAMPLE)
def test_query(spark, con, name):
    frame, sql = entry.queries()[name](spark, DIR), entry.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert compare(frame, con, sql) is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["tx_id", "card_id", "risk_score", "decision", "applied_rules"]
    assert frame.count() == 1000


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120

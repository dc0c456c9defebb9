"""3-D Secure decisions and challenge sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.text import same_text
from tallyguard.operators.lookups import one_per_key
from tallyguard.operators.snapshots import latest_per_key

# Limits, codes and names of the authentication protocol.
FRICTIONLESS_UP_TO = 300
CHALLENGE_UP_TO = 700
FALLBACK_SCORE = 850
ECI_NOT_AUTHENTICATED = "07"
ECI_EVEN_SCORE = "05"
ECI_ODD_SCORE = "02"
FLOWS = {"Y": "FRICTIONLESS", "C": "CHALLENGE", "R": "REJECTED"}
ACTIONS = {"AUTHENTICATED": "APPROVE", "NOT_AUTHENTICATED": "DECLINE"}


def score_or_fallback(score: Column) -> Column:
    return F.coalesce(score, F.lit(FALLBACK_SCORE))


def transaction_status(score: Column) -> Column:
    return F.when(score <= FRICTIONLESS_UP_TO, "Y").when(score <= CHALLENGE_UP_TO, "C").otherwise("R")


def challenge_mandated(status: Column) -> Column:
    return status == "C"


def flow(status: Column) -> Column:
    return _lookup(FLOWS, status)


def action(outcome: Column) -> Column:
    return _lookup(ACTIONS, outcome)


def _lookup(names: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def is_authenticated(status: Column) -> Column:
    return F.coalesce(same_text(status, F.lit("Y")), F.lit(False))


def eci(score: Column, authenticated: Column) -> Column:
    by_parity = F.when(score % 2 == 0, ECI_EVEN_SCORE).otherwise(ECI_ODD_SCORE)
    return F.when(authenticated, by_parity).otherwise(ECI_NOT_AUTHENTICATED)


def assess(requests: DataFrame, scores: DataFrame) -> DataFrame:
    """Status of every request; one without a score gets the fallback score and is rejected."""
    joined = requests.join(one_per_key(scores.select("tx_id", "risk_score"), "tx_id"), "tx_id", "left")
    joined = joined.withColumn("risk_score", score_or_fallback(F.col("risk_score")))
    joined = joined.withColumn("trans_status", transaction_status(F.col("risk_score")))
    return joined.withColumns(
        {"challenge_mandated": challenge_mandated(F.col("trans_status")), "flow": flow(F.col("trans_status"))}
    )


def complete_challenges(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Results (trans_id, result_status, result_ms where known) of registered sessions (trans_id, risk_score)."""
    joined = results.join(one_per_key(sessions.select("trans_id", "risk_score"), "trans_id"), "trans_id")
    ok = is_authenticated(F.col("result_status"))
    return joined.select(
        "trans_id",
        "risk_score",
        F.when(ok, "Y").otherwise("N").alias("trans_status"),
        eci(F.col("risk_score"), ok).alias("eci"),
        F.when(ok, "COMPLETED").otherwise("FAILED").alias("state"),
        action(F.when(ok, "AUTHENTICATED").otherwise("NOT_AUTHENTICATED")).alias("action"),
        *[c for c in ("result_ms",) if c in results.columns],
    )


def unknown_results(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose session was never registered."""
    return results.join(sessions.select("trans_id"), "trans_id", "left_anti").select(results.columns)


def session_states(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Newest state per registered session from its log of openings and results; of several results
    the last by ``result_ms`` counts (without that column, or at equal times, a completed one less
    than a failed one)."""
    opened = sessions.select("trans_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("at"), F.lit("PENDING").alias("state"))
    done = complete_challenges(sessions, results)
    at = F.col("result_ms").cast("long") if "result_ms" in done.columns else F.lit(None).cast("long")
    closed = done.select("trans_id", F.lit(1).alias("step"), at.alias("at"), "state")
    return latest_per_key(opened.unionByName(closed), ["trans_id"], ["step", "at", "state"]).drop("at")


def active_sessions(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("state") == "PENDING").alias("active_sessions"))

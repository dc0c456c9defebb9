"""Score fusion, decision and the full decision row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.rules import DEFAULT_RULES, MAX_RULE_SCORE, Rule, scores_by_name, with_rule_scores


@dataclass(frozen=True)
class ScoringOptions:
    rule_weight: float = 0.4
    model_weight: float = 0.6
    approve_up_to: int = 300
    decline_from: int = 700


DEFAULTS = ScoringOptions()


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fused_score(rule_score: Column, probability: Column, options: ScoringOptions = DEFAULTS) -> Column:
    """Risk score 0..1000; rules alone where there is no probability."""
    rules = rule_score.cast("double") / F.lit(float(MAX_RULE_SCORE)) * F.lit(1000.0)
    model = probability.cast("double") * F.lit(1000.0)
    fused = rules * F.lit(options.rule_weight) + model * F.lit(options.model_weight)
    raw = F.when(probability.isNotNull(), fused).otherwise(rules)
    return clamp(F.round(raw), 0.0, 1000.0).cast("int")


def decision(score: Column, options: ScoringOptions = DEFAULTS) -> Column:
    return (
        F.when(score <= options.approve_up_to, "APPROVE")
        .when(score >= options.decline_from, "DECLINE")
        .otherwise("CHALLENGE")
    )


def model_scores(rules: Sequence[Rule], probability: Column) -> Column:
    """``rule.<NAME>`` for every rule that ran, and ``ml.onnx`` where a probability exists."""
    rules_only = scores_by_name(rules, "rule.", kind="double")
    with_model = scores_by_name(rules, "rule.", {"ml.onnx": probability}, "double")
    return F.when(probability.isNull(), rules_only).otherwise(with_model)


def risk_band(score: Column) -> Column:
    """Band of a 0..1000 score; 0.85 itself is still HIGH."""
    unit = score / F.lit(1000.0)
    return F.when(unit < 0.3, "LOW").when(unit < 0.6, "MEDIUM").when(unit <= 0.85, "HIGH").otherwise("CRITICAL")


def score_transactions(
    enriched: DataFrame,
    probability: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    options: ScoringOptions = DEFAULTS,
) -> DataFrame:
    """Enriched transactions with all decision columns added.

    ``probability`` names a column with the model's fraud probability; without it every row is
    scored by rules alone. Stateless, so it runs on streams as well.
    """
    p = F.col(probability).cast("double") if probability else F.lit(None).cast("double")
    scored = with_rule_scores(enriched, rules)
    scored = scored.withColumn("risk_score", fused_score(F.col("rule_score"), p, options))
    return scored.withColumns(
        {
            "decision": decision(F.col("risk_score"), options),
            "model_scores": model_scores(rules, p),
            "fallback_used": p.isNull(),
        }
    )


def decision_rows(scored: DataFrame) -> DataFrame:
    """The decision record; keeps the merchant, which the decline alerts group by.

    The decision time is the transaction's own time, so that a rerun gives the same rows.
    """
    return scored.select(
        "tx_id",
        "card_id",
        "merchant_id",
        "risk_score",
        "decision",
        "applied_rules",
        "model_scores",
        F.lit(0).cast("long").alias("latency_ms"),
        F.col("ts_ms").alias("decision_ms"),
    )

"""Risk rules as column expressions, and the rule set that adds them up."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.card_windows import HOUR_MS

# Merchant categories that count as high risk.
HIGH_RISK_MCC = ["7995", "5967", "5912", "5122"]

# Fixed value: highest sum the six built-in rules can reach.
MAX_RULE_SCORE = 140


@dataclass(frozen=True)
class Rule:
    """A named score. ``build`` returns an integer column; null means the rule failed on the row."""

    name: str
    build: Callable[[], Column]

    @property
    def column(self) -> str:
        return f"rule_{self.name.lower()}"


def _velocity() -> Column:
    count = F.col("tx_count_1h")
    return F.when(count > 10, 30).when(count > 5, 15).otherwise(0)


def _amount_anomaly() -> Column:
    amount, usual = F.col("amount"), F.col("avg_amount_7d")
    return (
        F.when(usual <= 0, 0).when(amount > usual * 3.0, 25).when(amount > usual * 2.0, 10).otherwise(0)
    )


def _geo_anomaly() -> Column:
    changed = F.coalesce(F.col("country_changed"), F.lit(False))
    soon = F.col("time_since_last_tx_ms") < HOUR_MS
    return F.when(changed & soon, 40).when(changed, 15).otherwise(0)


def _merchant_category() -> Column:
    return F.when(F.col("mcc").isin(HIGH_RISK_MCC), 15).otherwise(0)


def _device_change() -> Column:
    return F.when(F.col("device") != F.col("device_hash"), 20).otherwise(0)


def hour_of_day(ts_ms: str = "ts_ms") -> Column:
    """UTC hour, whatever the session time zone."""
    return F.pmod(F.floor(F.col(ts_ms) / F.lit(HOUR_MS)), F.lit(24)).cast("int")


def _time_anomaly() -> Column:
    return F.when(hour_of_day().between(1, 5), 10).otherwise(0)


DEFAULT_RULES = (
    Rule("VELOCITY", _velocity),
    Rule("AMOUNT_ANOMALY", _amount_anomaly),
    Rule("GEO_ANOMALY", _geo_anomaly),
    Rule("MERCHANT_CATEGORY", _merchant_category),
    Rule("DEVICE_CHANGE", _device_change),
    Rule("TIME_ANOMALY", _time_anomaly),
)


def _isolated(score: Callable[[pd.DataFrame], pd.Series], batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    """The scores of a batch, null for the rows that raise. Pieces write into one result."""
    values, failed = np.zeros(len(batch), "int64"), np.ones(len(batch), bool)
    pieces = [(0, len(batch))]
    while pieces:
        low, high = pieces.pop()
        try:
            found = score(batch if high - low == len(batch) else batch.iloc[low:high])
            if found.dtype != np.int64:
                found = found.astype("Int64")
        except Exception:
            if low == 0 and high == len(batch) > 1:
                first, place = _different(batch)
                if len(first) < len(batch):
                    return _isolated(score, batch.iloc[first].reset_index(drop=True))[place]
            if high - low > 1:
                middle = low + (high - low) // 2
                pieces += [(low, middle), (middle, high)]
            continue
        if len(found) != high - low:
            raise ValueError(f"{len(found)} scores for {high - low} rows")
        failed[low:high] = found.isna()
        values[low:high] = found.fillna(0)
    return pd.arrays.IntegerArray(values, failed)


def _different(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that differ in some input, and for each row which of them it equals."""
    # -0.0 equals 0.0, but a rule can tell them apart.
    signs = [np.signbit(batch[name]) for name in batch.columns if batch[name].dtype.kind == "f"]
    try:
        place = batch.groupby([*(batch[name] for name in batch.columns), *signs], dropna=False, sort=False).ngroup().to_numpy()
    except TypeError:  # lists and structs have no hash
        place = np.arange(len(batch))
    return np.unique(place, return_index=True)[1], place


def python_rule(name: str, inputs: Sequence[str], score: Callable[[pd.DataFrame], pd.Series]) -> Rule:
    """A rule written in pandas. A batch that raises is halved until only the rows at fault are
    left; they come out null, the others keep their score. Rows of equal inputs are tried once."""
    names = list(inputs)

    @F.pandas_udf("int")
    def run(batch: pd.DataFrame) -> pd.Series:
        batch.columns = names
        return pd.Series(_isolated(score, batch))

    return Rule(name, lambda: run(F.struct(*names)))


def with_rule_scores(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add one column per rule, ``rule_score`` (their sum), ``applied_rules`` and ``rule_scores``.

    A failed (null) rule is left out of the map and of the sum; the others still count.
    """
    names = [rule.name for rule in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"rule names must be unique, got: {names}")
    df = df.withColumns({rule.column: rule.build().cast("int") for rule in rules})
    if not rules:
        return df.withColumns(
            {
                "rule_score": F.lit(0),
                "applied_rules": F.array().cast("array<string>"),
                "rule_scores": F.create_map().cast("map<string,int>"),
            }
        )
    total = sum((F.coalesce(F.col(r.column), F.lit(0)) for r in rules[1:]), F.coalesce(F.col(rules[0].column), F.lit(0)))
    # Removing a literal stays in generated code, unlike a filter with a lambda.
    fired = F.array_remove(F.array(*[F.when(F.col(r.column) > 0, F.lit(r.name)).otherwise("") for r in rules]), "")
    return df.withColumns({"rule_score": total, "applied_rules": fired, "rule_scores": scores_by_name(rules)})


def scores_by_name(rules: Sequence[Rule], prefix: str = "", extra: Mapping[str, Column] | None = None, kind: str = "int") -> Column:
    """Map of rule scores (and ``extra`` values) without those that are null."""
    named = {f"{prefix}{rule.name}": F.col(rule.column).cast(kind) for rule in rules}
    named |= {name: value.cast(kind) for name, value in (extra or {}).items()}
    full = F.create_map(*[part for name, value in named.items() for part in (F.lit(name), value)])
    # Only rows with a null value pay for the filter.
    whole = reduce(lambda a, b: a & b, [value.isNotNull() for value in named.values()])
    return F.when(whole, full).otherwise(F.map_filter(full, lambda _, value: value.isNotNull()))


def in_high_risk_list(df: DataFrame, codes: DataFrame, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Rows whose ``mcc`` is in the table ``codes``; the list is broadcast only when proven small."""
    codes = codes.select("mcc").distinct()
    small = codes.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    return df.join(F.broadcast(codes) if small else codes, "mcc", "left_semi").select(df.columns)

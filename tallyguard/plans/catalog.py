"""All registered queries (importing the modules registers them)."""

from tallyguard.plans import audit_queries, card_queries, device_queries, score_queries, stream_queries  # noqa: F401
from tallyguard.plans.card_queries import flagship
from tallyguard.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]

"""The registered queries."""

from reachbase.plans import feed_queries, housing_queries, network_queries, rule_queries, search_queries, transit_queries  # noqa: F401
from reachbase.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Registered queries and their DuckDB counterparts."""

from lumeset.plans import oracles, registered, resumed

QUERIES = registered.QUERIES | resumed.QUERIES
ORACLES = oracles.ORACLES | resumed.ORACLES
FLAGSHIP = "diverse_topk"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

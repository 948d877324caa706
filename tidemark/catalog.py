"""All queries of the package, and the SQL that states the same over the same tables."""

from __future__ import annotations

from tidemark.plans import cluster, convert, kv, mvcc, regions, relational, upkeep

_PLANS = (kv, mvcc, cluster, relational, upkeep, convert, regions)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: text for plan in _PLANS for name, text in plan.ORACLES.items()}

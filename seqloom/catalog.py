"""All queries of the library with their DuckDB SQL."""

from __future__ import annotations

from seqloom.plans import cube_queries, evaluation_queries, grid_queries, mining_queries, more_queries, pair_queries, relational_queries, sequence_queries, weak_queries  # noqa: F401  (imports register the queries)
from seqloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

"""All queries of the engine by name, with the SQL each is held against."""

from __future__ import annotations

from palimpsest.plans import aggregates, changes, forecasts, media, noise, relations, retrieval, scalars, segments, sequences, streams  # noqa: F401 (they register)
from palimpsest.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "ret01_search"

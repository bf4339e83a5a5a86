"""The queries by name, with the SQL that checks them."""

from __future__ import annotations

from termloom.plans import source_queries, vocabulary_queries  # noqa: F401  (they register their queries)
from termloom.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "exact_match_bigrams"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

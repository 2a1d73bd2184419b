"""Operators for large text corpora and their registered queries.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from mercato.llm import queries_more  # noqa: F401  (registers its queries)
from mercato.llm.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

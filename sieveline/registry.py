"""All queries of the library, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from sieveline.plans import design, files, leakage, quality  # noqa: F401  they register their queries
from sieveline.plans.book import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "query"]

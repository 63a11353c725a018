"""Queries by name, with their SQL."""

from weft.plans import events, more, relational, reports, streams  # noqa: F401
from weft.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""The engine's queries and their SQL, by name."""

from __future__ import annotations

from reqloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""The registered grid queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from gyre.plans.queries import ORACLE, QUERIES

FLAGSHIP = "geo_nearest"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

"""Queries over the driver's tables, one or more for each operator."""

from foliospark.plans import analytics, cases, documents, flows, inputs, papers, scalars  # noqa: F401
from foliospark.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

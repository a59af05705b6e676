"""All registered compound queries: importing a query module enters its queries."""

from leadlight.plans import queries, route_queries, vector_queries  # noqa: F401
from leadlight.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

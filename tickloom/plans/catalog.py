"""All registered queries."""

from tickloom.plans import checks, flows, market, profiles, streams  # noqa: F401
from tickloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

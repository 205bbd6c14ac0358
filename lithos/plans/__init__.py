"""Queries of the engine over the driver's tables, each with its SQL where SQL can say it."""

from lithos.plans import feeds, fires, floods, quakes, tables, validation  # noqa: F401
from lithos.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

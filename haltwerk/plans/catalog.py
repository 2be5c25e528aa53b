"""All registered queries."""

from haltwerk.plans import queries_core, queries_quality, queries_stats  # noqa: F401
from haltwerk.plans.registry import QUERIES

__all__ = ["QUERIES"]

"""The registered queries and their SQL twins."""

from depchron.plans import analysis, core
from depchron.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis", "core"]

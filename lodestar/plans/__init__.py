"""Queries over the driver's tables, by section."""

from lodestar.plans import advanced, files, needs, relational
from lodestar.plans.standins import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "advanced", "files", "needs", "relational"]

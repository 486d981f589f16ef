"""Queries over the given tables, one or more per operator, each with its SQL."""

from rowloom.reports import analyse, catalogs, compare, convert, index, retrieve, streams  # noqa: F401
from rowloom.reports.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

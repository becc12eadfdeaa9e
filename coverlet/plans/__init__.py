"""Queries over the supplied tables, with the same in SQL."""

from . import matching_queries, structure_queries, syllabus_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

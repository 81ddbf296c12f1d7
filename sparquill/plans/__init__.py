"""Queries over the star schema, with their SQL: what the library is measured and checked by."""

from .queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

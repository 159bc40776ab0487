"""Queries of the engine's operators over the TPC-H-like tables, each with the same query in SQL."""

from rangeframe.suite import metadata, stored, tables
from rangeframe.suite.registry import QUERIES, oracle_sql, queries
from rangeframe.suite.tables import flagship

__all__ = ["QUERIES", "flagship", "metadata", "oracle_sql", "queries", "stored", "tables"]

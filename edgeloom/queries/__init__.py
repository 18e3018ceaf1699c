"""Registered queries: each operator on the given tables, with its SQL twin."""

from edgeloom.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]

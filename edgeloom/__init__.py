"""Typed-graph analytics expressed as Spark DataFrame jobs."""

from edgeloom.session import build_session, cut_lineage, owned_tables, shared_dir

__all__ = ["build_session", "cut_lineage", "owned_tables", "shared_dir"]

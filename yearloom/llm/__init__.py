"""Operators for large-scale training-text preparation; nothing outside this subpackage imports it."""

from yearloom.llm.catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

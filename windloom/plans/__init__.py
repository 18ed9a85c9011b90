"""Registered queries of the sensor and retrieval operators, with their DuckDB equivalents."""

from windloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

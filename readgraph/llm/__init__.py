"""Operators of training-data pipelines. Nothing outside this folder imports it."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

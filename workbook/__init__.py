"""Registered queries: each operator over the given tables, with the SQL it must agree with."""

from workbook.registry import ORACLE, QUERIES

from workbook import builds, clean, geography, learning, profiles, quality, state, storage, temporal, weather  # noqa: E402,F401

__all__ = ["ORACLE", "QUERIES"]

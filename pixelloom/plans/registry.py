"""Queries of the library by name, and their DuckDB equivalents."""

from __future__ import annotations

from pixelloom.plans import queries_pixels, queries_tables

QUERIES = {**queries_pixels.QUERIES, **queries_tables.QUERIES}
ORACLE_SQL = {**queries_pixels.ORACLE_SQL, **queries_tables.ORACLE_SQL}

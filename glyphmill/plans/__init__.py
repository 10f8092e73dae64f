"""Queries on the driver's tables, with their DuckDB counterparts."""

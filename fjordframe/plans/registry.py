"""Collects the queries of every plan module, with their DuckDB counterparts."""

from __future__ import annotations

from fjordframe.plans import complex_queries, hist_queries, series_queries, source_queries, structure_queries, surface_queries, thermo_queries

MODULES = (thermo_queries, hist_queries, series_queries, surface_queries, structure_queries, complex_queries, source_queries)


def core_queries() -> dict:
    """Query name to function, over all plan modules."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def core_oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, over all plan modules."""
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

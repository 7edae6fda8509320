"""All queries of the library with their DuckDB equivalents."""

from __future__ import annotations

from simplicia.plans import bundles, composed, evaluation, learning, panels, series, shapes

_MODULES = (series, shapes, panels, evaluation, learning, composed, bundles)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}

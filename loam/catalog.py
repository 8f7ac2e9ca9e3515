"""The registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from loam.plans import records, search, structures

MODULES = (search, records, structures)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

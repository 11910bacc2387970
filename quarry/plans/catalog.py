"""Every query of the engine and its SQL."""

from __future__ import annotations

from quarry.plans import durable, engine, evaluation, extras, operations, planning, relational, scalars, scans

_MODULES = (scalars, relational, planning, engine, evaluation, operations, scans, extras, durable)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

"""Every named query over the provided tables, and the SQL each is held against."""

from __future__ import annotations

from tapeloom.plans import depth, feeds, market, operations, research, wires

_PARTS = (market, research, operations, feeds, depth, wires)


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}

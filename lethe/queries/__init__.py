"""Registered queries: each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from . import cascade, discovery, events, functions, plans

MODULES = (cascade, discovery, events, functions, plans)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}

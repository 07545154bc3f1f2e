"""All queries by name, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from keelson.plans import objects, relations, workloads, writes

_PARTS = (relations, objects, writes, workloads)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.CATALOGUE.queries
    ORACLE_SQL |= _part.CATALOGUE.sql

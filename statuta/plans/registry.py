"""Registered queries over the engine's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from statuta.plans import queries_retrieval, queries_sources, queries_state, queries_text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (queries_retrieval, queries_text, queries_sources, queries_state):
    QUERIES |= _module.REGISTRY.queries
    ORACLE_SQL |= _module.REGISTRY.sql

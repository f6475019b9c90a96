"""Registered queries of the engine's operators; each is defined in a module of granary.catalog with its SQL."""

from __future__ import annotations


def _entries() -> dict:
    from granary.catalog import details, documents, evidence, operations, retrieval, tables

    found: dict = {}
    for module in (tables, operations, retrieval, documents, evidence, details):
        found.update(module.QUERIES)
    return found


def queries() -> dict:
    return {name: run for name, (run, _) in _entries().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _entries().items() if sql}

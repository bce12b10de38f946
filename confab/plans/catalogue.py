"""All queries of the core with their SQL twins."""

from __future__ import annotations

from confab.plans import identity, intervals, naming, problems, records, reports, signals, store, text, vectors

MODULES = (problems, store, intervals, reports, text, vectors, naming, signals, records, identity)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}

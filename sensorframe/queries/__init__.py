"""Registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from sensorframe.queries import cruise, requests, series

_MODULES = (series, requests, cruise)


def all_queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

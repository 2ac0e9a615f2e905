"""All queries of the vibration library by name, and their SQL."""

from __future__ import annotations

from . import checks, lines, signals, stream, tables

_ALL = stream.QUERIES | signals.QUERIES | tables.QUERIES | lines.QUERIES | checks.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

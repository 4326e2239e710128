"""All queries of the package with their SQL twins."""

from __future__ import annotations

from .plans import queries as _plans


def queries() -> dict:
    return _plans.queries()


def oracle_sql() -> dict[str, str]:
    return _plans.oracle_sql()

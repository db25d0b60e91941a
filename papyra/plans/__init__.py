"""Queries over the driver's tables, one for each operator that a table can show."""

from __future__ import annotations

from papyra.plans.registry import QUERIES, SQL, Query


def _load() -> None:
    from papyra.plans import bibliography, indexes, passages, ranking, records, relational, series  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

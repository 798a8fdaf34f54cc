"""Every operator as a query over the fixture tables, with the SQL that checks it."""

from __future__ import annotations

from .registry import CHECKS, QUERIES, Query


def _load() -> None:
    from . import coarse, derived, gaps, layouts, relations, samples, scoring, sources, statistics, streams, user_states, verification  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(CHECKS)

"""Registered queries over the given tables, each with the same query in SQL."""

from __future__ import annotations

from parley.plans.registry import QUERIES, SQL, Query


def _load() -> None:
    from parley.plans import (  # noqa: F401
        completion_queries,
        embedding_queries,
        request_queries,
        stream_queries,
        telemetry_queries,
    )


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Registers ``fn(v)``, where ``v(name)`` gives a view or table, as a query; and
    its SQL over the same views."""
    from ..sources.views import deal, view, with_views

    def run(fn: Callable, spark, sf_dir: str):
        deal(spark, sf_dir)
        return fn(lambda n: view(spark, sf_dir, n))

    def add(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: run(fn, spark, sf_dir)
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return add


def _load() -> None:
    from . import q_checks, q_facts, q_logs, q_more, q_rest  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

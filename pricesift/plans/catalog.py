"""Query catalog: name -> (Spark DataFrame builder, DuckDB oracle SQL or None).

Query modules register themselves with ``@query``; ``__spark_entry__`` reads
``spark_queries()`` and ``oracle_queries()`` from here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import VIEW_DEPS, VIEW_SQL, with_views
from . import sql_exprs

VIEW_SQL["norm"] = sql_exprs.NORMALIZED_SQL
VIEW_DEPS["norm"] = ["offers_q"]
for _name, (_sql, _deps) in sql_exprs.SEARCH_VIEWS.items():
    VIEW_SQL[_name], VIEW_DEPS[_name] = _sql, _deps

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[QueryFn, str | None, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql, views)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import (q_pricing, q_relational, q_text, q_vectors,  # noqa: F401
                   q_insights, q_learning, q_pages, q_match)


def spark_queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load_all()
    return {k: with_views(sql, *views) if views else sql for k, (_, sql, views) in _REGISTRY.items() if sql}

"""Registry of named queries: key → (Spark builder, DuckDB oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables.  The oracle SQL computes the same result on the same tables
(pre-registered as views) and uses the same output column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a builder under ``key`` (and its oracle SQL when it has one)."""

    def deco(fn: Builder) -> Builder:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLE[key] = sql.strip()
        return fn

    return deco


def _load_all() -> None:
    from . import (  # noqa: F401  (modules register on import)
        q_sources,
        q_clean,
        q_joins,
        q_aggregates,
        q_windows,
        q_sets,
        q_functions,
        q_tokens,
        q_learn,
        q_sample,
        q_metrics,
        q_alerts,
        q_models,
        q_explain,
        q_reports,
    )


def all_queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)

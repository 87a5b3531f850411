"""Name -> (Spark query, oracle SQL) registry.

Every registered query takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole input tables.  The oracle SQL (DuckDB dialect, base tables as
views) computes the same rows; ``None`` marks a query whose result is checked
by unit tests with tolerances instead (models, streams, approximate methods).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    ids: tuple[str, ...]
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(ids), (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the plan modules fills the registry.
    from . import rowwise, ordered, stats, joins_sets, text_reports, ml_plans, streaming_plans, sources_plans, report_plans  # noqa: F401
    return REGISTRY

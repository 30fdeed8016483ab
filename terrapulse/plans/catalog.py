"""Registry of named queries: Spark plan + DuckDB oracle SQL + survey ids.

Each query module registers its entries with ``@query(...)``; the driver
contract in ``__spark_entry__.py`` reads this registry.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}

#: Stands in an oracle's SQL for the folder of published node tables.
PUBLISHED = "@published@"


def oracles(spark: SparkSession | None) -> dict[str, str]:
    """Oracle SQL by query. What needs a published table is left out where its folder can't be known or read."""
    folder = None
    if spark is not None:
        path = scratch_path(spark, "published")
        folder = path.removeprefix("file://").removeprefix("file:")
    known = {name: e.sql for name, e in load_all().items() if e.sql and (folder is not None or PUBLISHED not in e.sql)}
    if folder is not None and "://" in folder:
        known = {name: sql for name, sql in known.items() if PUBLISHED not in sql}
    return {name: sql.replace(PUBLISHED, folder or "") for name, sql in known.items()}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql.strip() if sql else None, tuple(ids.split()))
        return fn
    return deco


MODULES = ["queries_forest", "queries_urban", "queries_climate", "queries_matching",
           "queries_stats", "queries_text", "queries_payloads", "queries_ml", "queries_report",
           "queries_stream", "queries_series"]


def load_all() -> dict[str, Entry]:
    import importlib
    import importlib.util
    for mod in MODULES:
        full = f"{__package__}.{mod}"
        if importlib.util.find_spec(full) is not None:
            importlib.import_module(full)
    return REGISTRY

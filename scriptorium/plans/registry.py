"""All registered queries with their SQL.

``@query(sql)`` registers a function (spark, sf_dir) -> DataFrame under its
name, with the statement that DuckDB runs over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "f4_bm25"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


for _name in ("sources", "filters", "joins", "aggregates", "ordering", "search", "texts", "records", "state", "documents"):
    import_module(f"scriptorium.plans.{_name}")

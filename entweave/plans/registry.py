"""All registered queries and their SQL.  A query is a function (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "r5_lookup_batch"


def query(sql: str | None = None):
    """Register the function under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import decision_queries, file_queries, ingest_queries, lookup_queries, record_queries, store_queries, table_queries, text_queries  # noqa: E402,F401

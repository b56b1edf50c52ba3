"""The queries and the SQL they are checked against, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL where SQL can state it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


for _module in ("ingest", "vector", "extraction", "graph", "retrieval", "hybrid", "answering", "evaluation", "gateway", "research"):
    importlib.import_module(f"{__package__}.{_module}")

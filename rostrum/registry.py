"""Registry of the engine's own queries and the SQL that each must equal.

The driver's tables stand in for the engine's relations: customer for sittings, orders for records and,
by (o_custkey, o_orderkey), for transcript versions, events for word streams, attempts and audit entries,
conversations and documents for passages, embeddings for passage vectors, nation, region, supplier and
part for dictionaries and templates, labels for gold judgements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it must equal."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f.__name__)
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

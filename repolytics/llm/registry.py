"""Registered queries of this package: name, function of (spark, folder), SQL twin."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")

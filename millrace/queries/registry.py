"""Queries by name, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Build], Build]:
    """Register a query and its DuckDB form."""

    def add(build: Build) -> Build:
        if name in BUILDS:
            raise ValueError(f"query {name} is registered twice")
        BUILDS[name] = build
        SQL[name] = sql.strip()
        return build

    return add

"""Registered queries: name -> callable, the matching SQL, and the inventory rows each one covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register

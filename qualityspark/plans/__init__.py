"""Registered queries: each a callable over a table folder, most with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from qualityspark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Schemas read from file footers once, instead of by a job per query.
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """Tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    from qualityspark.plans import (  # noqa: F401
        collections,
        documents,
        files,
        harvest,
        lookups,
        scoring,
        sequences,
        series,
        stores,
        streams,
        texts,
    )

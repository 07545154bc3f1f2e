"""The shared tables, with explicit names, and a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one folder, read when asked for: tables.orders, tables.lineitem, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Catalogue:
    """Queries by name with their SQL counterparts."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None):
        def register(program: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: program(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return program

        return register

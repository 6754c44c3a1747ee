"""The query registry: a name, a function from tables to a DataFrame, and optionally the checking SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.sources.readers import read_table

TEXT_TABLES = ("documents", "pages", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = ["quality", "joining", "grouping", "trends", "windowing", "episodes", "spectra", "ranking",
           "scalars", "texts", "portfolios", "sourcing", "studies", "study_tables"]


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", cpu_heavy=name in TEXT_TABLES)


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with its SQL when the answer can be stated in SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"seriesloom.plans.{module}")

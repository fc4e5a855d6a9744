"""Queries by name with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.postings import CTE, postings


@dataclass
class Tables:
    """The tables of a folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def postings(self) -> DataFrame:
        return postings(self.spark, self.folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, view: bool = False) -> Callable:
    """Registers a function from tables to a result; view says that the SQL reads the announcements as p."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = (f"with {CTE}, {sql[5:]}" if sql.startswith("with ") else f"with {CTE} {sql}") if view else sql
        return f

    return put

"""Registry of queries over the given tables, each with its comparison SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import prepare
from .views import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, recursive: bool = False, views: dict | None = None):
    def register(build):
        text = with_views(sql, views, recursive) if sql else None
        QUERIES[name] = Query(name, covers, build, text)
        return build
    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to a fixed number of digits (and no negative zero), so both engines print the same value."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])

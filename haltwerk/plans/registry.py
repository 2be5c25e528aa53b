"""Registration of named queries and the common output format."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltwerk.plans.oracle import with_views
from haltwerk.sources.driver_tables import Tables

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return presented(self.build(Tables(spark, folder)))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: Mapping[str, str] | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` is its check statement over the oracle views, some of which ``views`` may replace."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = Query(name, build, with_views(sql, views) if sql else None)
        return build

    return register


def presented(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, doubles to six digits, times without zone (UTC)."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)

"""Requests and states derived from the given tables by fixed rules on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshledger.schemas import ENTITY

REGISTRY: dict[str, tuple] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def over_tasks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file, dealt over the tasks: one split is read by one task, and the requests made of its rows cost far more
    than their bytes. The number is given, as Spark puts partitions of few bytes together again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that states the same result."""
    def keep(function):
        REGISTRY[name] = (function, sql)
        return function
    return keep


def _filled(kind: T.DataType, value) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, dict):
        unknown = set(value) - set(kind.fieldNames())
        if unknown:
            raise ValueError(f"unknown fields {unknown}")
        return F.struct(*[_filled(f.dataType, value.get(f.name)).alias(f.name) for f in kind.fields])
    return value.cast(kind)


def entity(**variant) -> Column:
    """An entity with one variant, given as nested dicts of columns."""
    return _filled(ENTITY, variant)


def only_if(condition: Column, kind: str, values: dict) -> Column:
    """A nested object that is absent where the condition fails."""
    return F.when(condition, _filled(ENTITY[kind].dataType, values))


def tag(name: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(None).cast("string").alias("slug"),
                    F.lit(None).cast("string").alias("color"))


def as_requests(rows: DataFrame, key: Column, entities: Column, *keep: str) -> DataFrame:
    """One request per row, arriving in the order of the key."""
    return rows.select(
        *keep, F.lit("latest").alias("stream"), F.concat(F.lit("r"), key.cast("string")).alias("id"),
        F.lit("agent").alias("producer_app_name"), F.lit("1.0.0").alias("producer_app_version"),
        F.lit("sdk").alias("sdk_name"), F.lit("1.0.0").alias("sdk_version"),
        entities.alias("entities"), key.cast("bigint").alias("ingestion_ts"))


def arrival(column: str = "seq") -> Column:
    """The key a request was made from, read back from its place in arrival order."""
    return F.substring(column, 1, 20).cast("bigint")


def shown(column: str = "object_key") -> Column:
    """A key with a printable separator."""
    return F.replace(F.col(column), F.lit("\x1f"), F.lit("|"))


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")

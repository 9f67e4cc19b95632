"""What the operators share: tables, training splits, staging and fixed column texts."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.session import stage

#: Upper and lower case of the letters A to Z, and the white space of a word boundary.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

__all__ = ["UPPER", "LOWER", "SPACE_CLASS", "SPACES", "table", "remainder", "held_out", "stage", "sample_rows",
           "labelled_sample", "few_rows", "settle"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Rows no label is learned from; a row without id is held out as well."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(True))


def sample_rows(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of the key: the same ones at any partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rest: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled ids that are not held out. Unequal labels of one id
    count as 1 if any is."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~rest)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = sample_rows(known, F.col("doc_id"), rows)
    return docs.select("doc_id", "text").dropDuplicates(["doc_id"]).join(F.broadcast(chosen), "doc_id")


def few_rows(build: Callable[[], DataFrame], spark: SparkSession, rows: int) -> DataFrame:
    """Stage a frame made from rows that hold whole texts, with few of them in an Arrow batch: a batch lies in the executor and
    in its Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        return stage(build())
    finally:
        spark.conf.set(name, before)


def settle(spark: SparkSession) -> None:
    """Let the driver collect what finished steps left; the shuffle files they own go with it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

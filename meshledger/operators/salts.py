"""Joins in which a few keys have most of the rows: as many salts per key as its rows ask for, none for the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.operators.carry import BROADCAST_KEYS, HOT_ROWS
from meshledger.session import stage

_SALT, _SALTS = "_salt", "_salts"
#: Rows that one task sorts or gathers: a node takes about a kilobyte there, but few bytes in the shuffle, by which Spark sizes tasks.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, number: int | None, *keys: str) -> DataFrame:
    """Rows by key on as many tasks as their number asks for; a small table, or one of unknown size, is left to Spark."""
    if number is None or number <= TASK_ROWS:
        return rows
    return rows.repartition(max(-(-number // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def shuffled(side: DataFrame, most: int) -> DataFrame:
    """A join's side of at most ``most`` rows: if these may be many, it is never sent through the driver. Estimates don't tell: a
    few columns of a staged wide table count as their share of all its columns, whatever is in them."""
    return side.hint("merge") if most > BROADCAST_KEYS else side


def few_or_shuffled(side: DataFrame, number: int) -> DataFrame:
    """A join's side of ``number`` rows: few go to every task, and the other side moves nowhere; more never go through the driver."""
    return F.broadcast(side) if number <= BROADCAST_KEYS else side.hint("merge")


def heavy_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS) -> DataFrame | None:
    """(keys, number of salts) of the keys with more than ``hot_rows`` rows, None if there are none.

    ``rows`` is staged: its number of rows comes from the file footers, and a small table needs no count by key. The
    limit grows with the table, so that there are never more than ``BROADCAST_KEYS`` such keys."""
    number = rows.count()
    if hot_rows is None or number <= hot_rows:
        return None
    limit = max(hot_rows, number // BROADCAST_KEYS)
    found = stage(rows.groupBy(*keys).count().where(F.col("count") > limit).select(
        *keys, F.ceil(F.col("count") / limit).cast("int").alias(_SALTS)))
    return None if found.isEmpty() else found


def join_salted(rows: DataFrame, side: DataFrame, keys: Sequence[str], heavy: DataFrame | None, *spread: str,
                most: int = 0) -> DataFrame:
    """Left join with a side that has at most one row per key. Rows of a heavy key go to its salts by the hash of
    ``spread``, and its row of the side goes to each; a null key matches nothing. ``most``: how many rows the side may have."""
    keys = list(keys)
    if heavy is None:
        return rows.join(shuffled(side, most), keys, "left")
    salt = F.when(F.col(_SALTS).isNotNull(), F.pmod(F.xxhash64(*spread), F.col(_SALTS))).otherwise(0).cast("int")
    marked = rows.join(F.broadcast(heavy), keys, "left").withColumn(_SALT, salt).drop(_SALTS)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1))
    copied = side.join(F.broadcast(heavy), keys, "left").withColumn(_SALT, copies).drop(_SALTS)
    return marked.join(shuffled(copied, most), [*keys, _SALT], "left").drop(_SALT)

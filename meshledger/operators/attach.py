"""Since when a parent is attached to its holder.

An object that is stored without a parent takes one only with a change of its own: as long as nothing else
differs, seeing the parent is no difference, so the object goes on without it, however often it is seen. Every later
parent is compared with the attached one, which is the last one seen *since* it was attached.

Attached is what is seen first, unless that root leaves the holder unchanged. Which roots do so is known only once all
changes are: they are decided under the attachments known so far, and decided again while the notes they leave
say otherwise. What a root does depends on earlier roots alone, so each round settles at least the next
attachment in arrival order; without a silently seen parent the first round is the only one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshledger.operators.salts import few_or_shuffled
from meshledger.session import stage

#: Later than any place in arrival order.
NEVER = "~"
SINCE = "_since"


def attachments(noted: DataFrame) -> DataFrame:
    """(object_type, object_key, reference, since): parents that are not attached by the root that saw them first.

    ``noted`` has a row for every root that saw parents (``noted``, by name) of a stored object without them, and
    whether the object was changed there."""
    rows = noted.select("object_type", "object_key", "seq", (F.col("object_id") == 1).alias("changed"),
                        F.explode(F.split("noted", ",")).alias("reference"))
    found = rows.groupBy("object_type", "object_key", "reference").agg(
        F.min("seq").alias("first"), F.min(F.when(F.col("changed"), F.col("seq"))).alias("since"))
    return found.where(~F.col("since").eqNullSafe(F.col("first"))).select(
        "object_type", "object_key", "reference", F.coalesce("since", F.lit(NEVER)).alias("since"))


def digest(since: DataFrame) -> tuple:
    return tuple(since.agg(F.count("*"), F.bit_xor(F.xxhash64(*since.columns))).first())


def by_object(since: DataFrame) -> DataFrame:
    """One row per object: a map from reference to since. Staged, as every carry of parents reads it."""
    entry = F.collect_list(F.struct("reference", "since"))
    return stage(since.groupBy("object_type", "object_key").agg(F.map_from_entries(entry).alias(SINCE)))


def add_attached(rows: DataFrame, since: DataFrame | None, columns: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """For every column with a seen parent (column -> reference) the name of one that has it only where it is attached.

    ``since`` is the result of :func:`by_object`; without it whatever is seen is attached."""
    if since is None:
        return rows, {c: c for c in columns}
    joined = rows.join(few_or_shuffled(since, since.count()), ["object_type", "object_key"], "left")

    def attached(column: str, reference: str) -> Column:
        start = F.coalesce(F.col(SINCE)[reference], F.lit(""))
        return F.when((F.col("seq") == "") | (F.col("seq") >= start), F.col(column))

    return (joined.select(*rows.columns, *[attached(c, r).alias("at_" + c) for c, r in columns.items()]),
            {c: "at_" + c for c in columns})

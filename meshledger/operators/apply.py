"""Applying changes to the state, and what an inventory answers when it refuses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.functions.scalars import assigned_id
from meshledger.operators.fold import KEYS, empty_state_columns
from meshledger.registry import TAG_TYPE


def _tag_record(changes: DataFrame) -> DataFrame:
    """Created tags as state rows; the change's payload holds their whole record."""
    tag = F.from_json("data", "name STRING, slug STRING, color STRING")
    return changes.where(F.col("object_type") == TAG_TYPE).select(
        *KEYS, "seq", "ord", F.struct(assigned_id(*[F.col(k) for k in KEYS]).alias("object_id"),
                                      tag["slug"].alias("slug"), tag["color"].alias("color")).alias("tag"))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert: per object the record of its last change, else its stored row.

    The last change is found with a combining aggregate, so an object with very many changes
    costs one row per task; the state is joined to at most one row per object.
    """
    fields = [c for c in empty_state_columns() if c not in (*KEYS, "identity")]
    place = F.struct("seq", "ord")
    # A record has the fields of the batch's types; all others are null in any object of these types.
    have = set(changes.schema["record"].dataType.fieldNames())
    objects = changes.where(F.col("object_type") != TAG_TYPE).groupBy(*KEYS).agg(
        F.max_by("record", place).alias("r")).select(*KEYS, *[
            F.col("r")[f].alias(f) if f in have else F.lit(None).cast(state.schema[f].dataType).alias(f) for f in fields])
    tags = _tag_record(changes).groupBy(*KEYS).agg(F.min_by("tag", place).alias("t")).select(
        *KEYS, "t.object_id", "t.slug", "t.color")
    new = objects.unionByName(tags, allowMissingColumns=True).withColumn("_new", F.lit(True))
    old, new = state.alias("old"), new.alias("new")
    joined = old.join(new, KEYS, "full_outer")
    # A change record is complete: it holds everything the inventory knows of the object afterwards.
    picked = [F.when(F.col("new._new"), F.col("new." + f)).otherwise(F.col("old." + f)).alias(f) for f in fields]
    return joined.select(*KEYS, *picked, F.when(F.col("new._new"), F.lit(None).cast("string"))
                         .otherwise(F.col("old.identity")).alias("identity"))


def explode_apply_errors(responses: DataFrame) -> DataFrame:
    """One row per (change set, change, error) of the error maps an inventory returns."""
    rows = responses.select("change_set_id", F.explode("errors").alias("e"))
    return rows.select("change_set_id", F.col("e")["change_id"].alias("change_id"),
                       F.explode(F.map_filter("e", lambda k, _: k != "change_id")).alias("field", "error")
                       ).select("change_set_id", "change_id", "error")


def apply_error(responses: DataFrame) -> DataFrame:
    """(change_set_id, error): the refused change sets, each with its structured error."""
    each = lambda m: F.transform(
        F.map_entries(F.map_filter(m, lambda k, _: k != "change_id")),
        lambda kv: F.struct(kv["value"].alias("error"), m["change_id"].alias("change_id")))
    details = F.struct("change_set_id", "result", F.flatten(F.transform("errors", each)).alias("errors"))
    return responses.where(F.col("code") >= 400).select(
        "change_set_id", F.struct("message", "code", details.alias("details")).alias("apply_error"))

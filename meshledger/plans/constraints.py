"""Data quality: every declared constraint a request or its entities break. Off the main path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.operators.flatten import explode_entities, present_kinds, spread
from meshledger.operators.validate import entity_violations, request_violations


def check_constraints(requests: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, position, violation) with position null for the request itself. Planned for the kinds that occur."""
    own = requests.select("id", F.lit(None).cast("int").alias("position"),
                          F.explode(request_violations()).alias("violation"))
    entities = explode_entities(requests).where(F.col("entity").isNotNull())
    kinds = present_kinds(requests) if kinds is None else kinds
    if not kinds:
        return own
    inner = spread(entities.select("id", "position", "entity", "seq")).select("id", "position", F.explode(entity_violations(kinds)).alias("violation"))
    return own.unionByName(inner)

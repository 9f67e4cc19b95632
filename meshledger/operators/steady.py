"""Objects every root observes in the same way: only the first of these observations can matter.

Placeholders and parents named by nothing but their name are most of all nodes and sit on few
keys. If all observations of a key are equal, those after the first root's find exactly what the
first one left, so they need no place in the fold, only the object's id. Whether a key is steady
comes from one aggregate that combines before it shuffles, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.functions.scalars import assigned_id
from meshledger.operators.carry import BROADCAST_KEYS, HOT_ROWS
from meshledger.operators.fold import KEYS, guard_identity, quoted
from meshledger.operators.salts import few_or_shuffled, heavy_keys, join_salted, shuffled
from meshledger.registry import ALL, TYPES, Shape
from meshledger.session import release, stage

LEAVES = tuple(t.name for t in TYPES.values() if not t.references)
MADE = tuple(t.name for t in TYPES.values() if t.references == ("manufacturer",))
MAKER = "dcim.manufacturer"


def steady_keys(nodes: DataFrame, state: DataFrame, shape: Shape = ALL) -> DataFrame:
    """(type, key, first_seq, steady_id) of the keys that are observed alike in several roots, staged.

    Observations are alike if the smallest and the largest struct of all observed values are equal, nulls
    being values like any other. Types whose fields are all carried qualify if they have no parents, or a
    manufacturer that is steady too.
    """
    # Columns of other types are null in all of these. A parent that is only kept is not observed; slugs may be filled in later.
    own = [c for c in shape.scalars if any(c in TYPES[t].scalars for t in (*LEAVES, *MADE))]
    refs = ["ref_" + r for r in shape.references if r == "manufacturer"]
    values = F.struct("kept", "slug", "tags", *own, *refs)
    maker = F.col("ref_manufacturer") if "manufacturer" in shape.references else F.lit(None).cast("string")
    seen = nodes.where(f"object_type IN ({quoted((*LEAVES, *MADE))})").select(
        *KEYS, "seq", maker.alias("ref_manufacturer"), values.alias("values"))
    alike = seen.groupBy(*KEYS).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("ref_manufacturer").alias("maker"),
        F.min("values").eqNullSafe(F.max("values")).alias("alike"),
    ).where("alike").drop("alike")
    if "manufacturer" in shape.references:
        alike = stage(alike)
    makers = alike.where(F.col("object_type") == MAKER).select(F.col("object_key").alias("maker"))
    repeated = alike.where("last_seq > first_seq")
    leaves = repeated.where(f"object_type IN ({quoted(LEAVES)})")
    found = leaves
    if "manufacturer" in shape.references:
        made = repeated.where(f"object_type IN ({quoted(MADE)})")
        makers = shuffled(makers, alike.count())
        found = leaves.unionByName(made.join(makers, "maker", "left_semi")).unionByName(made.where("maker IS NULL"))
    found = found.select(*KEYS, "first_seq")
    stored = guard_identity(state.where(f"object_type IN ({quoted((*LEAVES, *MADE))})")).select(*KEYS, "object_id")
    steady = stage(found.join(shuffled(stored, state.count()), KEYS, "left").select(
        *KEYS, "first_seq", F.coalesce("object_id", assigned_id(*[F.col(k) for k in KEYS])).alias("steady_id")))
    if "manufacturer" in shape.references:
        release(nodes.sparkSession, alike)
    return steady


def split_steady(nodes: DataFrame, state: DataFrame, shape: Shape = ALL,
                 hot_rows: int | None = HOT_ROWS, steady: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes to fold, nodes that cannot be changed, with their object's id). ``nodes`` is staged; ``steady`` are its
    steady keys. Nodes of types that have none, and all where the keys are few, are not shuffled."""
    steady = steady_keys(nodes, state, shape) if steady is None else steady
    number, able = steady.count(), f"object_type IN ({quoted((*LEAVES, *MADE))})"
    rows = nodes.where(able)
    if number <= BROADCAST_KEYS:
        marked = rows.join(few_or_shuffled(steady, number), KEYS, "left")
    else:
        marked = join_salted(rows, steady, KEYS, heavy_keys(rows, KEYS, hot_rows), "seq", most=number)
    later = F.coalesce(F.col("seq") > F.col("first_seq"), F.lit(False))
    folded = marked.where(~later).select(*nodes.columns).unionByName(nodes.where(f"NOT {able}"))
    quiet = marked.where(later).select("seq", "slot", "ord", *KEYS, "placeholder", "kept",
                                       F.col("steady_id").alias("object_id"))
    return folded, quiet

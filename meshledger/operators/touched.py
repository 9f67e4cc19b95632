"""The part of the state a batch can meet: looked up once, staged, and read by every later step.

A batch meets the objects it names, the tags it names, platforms by name alone, the parents that stored holders have,
and what those are made of. These are at most three look-ups, each by the keys the one before gave; steps that need the state
several times read the few rows found, whatever the state is made of and however large it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshledger.functions.scalars import key_part
from meshledger.operators.salts import shuffled
from meshledger.registry import SLOTS, TAG_TYPE, Shape
from meshledger.session import release, stage

PLATFORM = "dcim.platform"
#: Reference of a stored holder -> type of the parent, for parents that a root may take from the holder.
HELD_TYPES = {
    "role": "dcim.devicerole", "device_type": "dcim.devicetype", "platform": PLATFORM, "site": "dcim.site",
    "cluster": "virtualization.cluster", "group": "virtualization.clustergroup", "type": "virtualization.clustertype",
}
HOLDERS = ("dcim.device", "virtualization.virtualmachine", "ipam.prefix", "virtualization.cluster")
#: What the second part of a parent's key names.
SCOPES = {PLATFORM: "dcim.manufacturer", "dcim.devicetype": "dcim.manufacturer", "virtualization.cluster": "dcim.site"}
LOOK = "look"


def look_of(object_type: Column, object_key: Column) -> Column:
    """What an object is looked up by: its key; a platform by its name alone."""
    return F.when(object_type == PLATFORM, F.coalesce(key_part(object_key, 1), F.lit(""))).otherwise(object_key)


def _key(object_type: str | Column, object_key: Column) -> Column:
    kind = F.lit(object_type) if isinstance(object_type, str) else object_type
    return F.struct(kind.alias("object_type"), look_of(kind, object_key).alias(LOOK))


def _distinct(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Distinct keys that are not null; combined within a task first, so a key that most rows have is no hot one."""
    found = rows.select(F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.*")
    return found.where(F.col(LOOK).isNotNull()).distinct()


def named_keys(keyed: DataFrame, shape: Shape) -> DataFrame:
    """(object_type, look) of all objects and tags that the roots name."""
    keys = [F.when(F.col("key_" + s).isNotNull(), _key(SLOTS[s].type.name, F.col("key_" + s))) for s in shape.slots]
    tags = F.explode(F.flatten(F.array_compact(F.array(*[F.col(f"given_{s}.tags.name") for s in shape.slots]))))
    named = keyed.select(tags.alias("name")).where("name IS NOT NULL").distinct()
    return _distinct(keyed, keys).unionByName(named.select(F.lit(TAG_TYPE).alias("object_type"), F.col("name").alias(LOOK)))


def held_keys(rows: DataFrame, shape: Shape) -> DataFrame:
    """(object_type, look) of the parents that stored holders have, and of what scopes those."""
    keys = []
    for reference in (r for r in HELD_TYPES if r in shape.references):
        kind, column = HELD_TYPES[reference], F.col("ref_" + reference)
        keys.append(F.when(column.isNotNull(), _key(kind, column)))
        if kind in SCOPES:
            keys.append(F.when(key_part(column, 2).isNotNull(), _key(SCOPES[kind], key_part(column, 2))))
    return _distinct(rows.where(F.col("object_type").isin(*HOLDERS)), keys)


def touched_state(keyed: DataFrame, look_up, shape: Shape) -> DataFrame:
    """``look_up`` gives the state's rows for distinct keys (object_type, look). The result is staged."""
    asked = stage(named_keys(keyed, shape))
    found = [stage(look_up(asked))]
    rounds = 0 if not any(SLOTS[s].type.name in HOLDERS for s in shape.slots) else 2 if "vm" in shape.slots else 1
    for _ in range(rounds):
        more = stage(held_keys(found[-1], shape).join(shuffled(asked, asked.count()), ["object_type", LOOK], "left_anti"))
        none = more.isEmpty()
        asked = asked.unionByName(more)
        if none:
            break
        found.append(stage(look_up(more)))
    release(keyed.sparkSession, asked)
    return reduce(DataFrame.unionByName, found)

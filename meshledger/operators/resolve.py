"""Which stored object stands behind a placeholder or an unobserved optional parent.

A placeholder parent never replaces a real one: if the object holding it already has such a
parent, that one is meant. Objects are found by key, so this rewrites keys, from the holder down:
device, machine or prefix first, then the cluster below a machine. An optional parent that is not
observed is *kept*: it stays in the payload but is not touched itself. What a holder has is what was last
seen since it was attached (see ``attach``); a placeholder that was attached counts below any real parent.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshledger.functions.scalars import absent_if_empty, key_part
from meshledger.operators.attach import add_attached
from meshledger.operators.carry import BROADCAST_KEYS, add_chunks, carry_forward
from meshledger.operators.flatten import is_placeholder
from meshledger.operators.salts import heavy_keys, join_salted, shuffled
from meshledger.registry import ALL, SEPARATOR, UNDEFINED, Shape
from meshledger.session import stage

HOLDERS = {"device": "dcim.device", "vm": "virtualization.virtualmachine", "prefix": "ipam.prefix"}
HELD = ("role", "device_type", "platform", "cluster", "site")
CLUSTER_HELD = ("cluster_group", "cluster_type")
#: Optional parents: a holder may have been given a placeholder of these and later be seen without any.
KEPT = ("platform", "cluster")
CLUSTER = "virtualization.cluster"
PLATFORM = "dcim.platform"


def _on(slot: str) -> Column:
    return F.col("on_" + slot)


def _observed_key(slot: str) -> Column:
    """Key of the object in a slot if it was really observed, not filled in."""
    return F.when(_on(slot) & ~is_placeholder(slot), F.col("key_" + slot))


def named_platforms(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """For every platform name, the key a look-up by name alone finds: the stored platform with
    the lowest id, else the one observed first."""
    stored = state.where(F.col("object_type") == PLATFORM).select(
        key_part(F.col("object_key"), 1).alias("platform_name"),
        F.col("object_key").alias("platform_key"),
        F.struct(F.lit("").alias("seq"), F.col("object_id").alias("id")).alias("place"))
    seen = keyed.where(_observed_key("platform").isNotNull()).select(
        key_part(F.col("key_platform"), 1).alias("platform_name"),
        F.col("key_platform").alias("platform_key"),
        F.struct(F.col("seq"), F.lit(None).cast("bigint").alias("id")).alias("place"))
    return stored.unionByName(seen).groupBy("platform_name").agg(
        F.min_by("platform_key", "place").alias("named_platform"))


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _first_of(values: list[Column]) -> Column:
    return F.coalesce(*values, F.lit(None).cast("string"))


def _narrow(keyed: DataFrame, shape: Shape) -> DataFrame:
    """The few columns the rules need, for the roots that have a holder, cluster or platform."""
    has = lambda *slots: _any([_on(s) for s in slots if s in shape.slots])
    holder = has("device", "vm")
    own = lambda where, slot: lambda: F.when(where, _observed_key(slot))
    owned = {
        "role": own(holder, "role"), "device_type": own(has("device"), "device_type"),
        "platform": lambda: _observed_key("platform"), "cluster": lambda: _observed_key("cluster"),
        "site": own(has("prefix"), "site"),
        "cluster_group": own(has("cluster"), "cluster_group"), "cluster_type": own(has("cluster"), "cluster_type"),
    }
    wanted = {
        "role": lambda: holder & is_placeholder("role"),
        "device_type": lambda: has("device") & is_placeholder("device_type"),
        "platform": lambda: holder & (is_placeholder("platform") | ~_on("platform")),
        "cluster": lambda: has("vm") & (is_placeholder("cluster") | ~_on("cluster")),
        "site": lambda: has("prefix") & is_placeholder("site"),
        "cluster_group": lambda: has("cluster") & is_placeholder("cluster_group"),
        "cluster_type": lambda: has("cluster") & is_placeholder("cluster_type"),
    }
    blank = {
        "platform": lambda: F.when(holder & is_placeholder("platform"), F.col("key_platform")),
        "cluster": lambda: F.when(has("vm") & is_placeholder("cluster"), F.col("key_cluster")),
    }
    holders = {s: t for s, t in HOLDERS.items() if s in shape.slots}
    columns = [
        "seq", _first_of([F.when(_on(s), F.lit(t)) for s, t in holders.items()]).alias("holder_type"),
        _first_of([F.when(_on(s), F.col("key_" + s)) for s in holders]).alias("holder_key"),
    ]
    where = has(*holders, "cluster")
    if "cluster" in shape.slots:
        columns.append(F.when(_on("cluster"), F.col("key_cluster")).alias("cluster_key"))
    if "platform" in shape.slots:
        by_name = _observed_key("platform").isNotNull() & ~_on("platform_manufacturer")
        where = where | by_name
        # A key no platform has keeps the rows without a look-up by name apart and spread out.
        columns.append(F.when(by_name, key_part(F.col("key_platform"), 1)).otherwise(
            F.concat(F.lit(SEPARATOR), "seq")).alias("platform_name"))
    for prefix, parts in (("own_", owned), ("want_", wanted), ("blank_", blank)):
        columns += [c().alias(prefix + n) for n, c in parts.items() if n in shape.slots]
    return keyed.where(where).select(*columns)


def _held_in_state(state: DataFrame, keys: DataFrame, references: dict[str, str], most: int) -> DataFrame:
    return state.join(shuffled(keys, most), ["object_type", "object_key"], "left_semi").select(
        "object_type", "object_key", F.lit("").alias("seq"),
        *[F.col("ref_" + r).alias("own_" + n) for n, r in references.items()])


def _latest(rows: DataFrame, names: tuple[str, ...], type_column: Column, key_column: Column,
            state: DataFrame, references: dict[str, str], hot_rows: int | None, since: DataFrame | None, most: int) -> DataFrame:
    """Add ``real_x``: the parent seen in this row, else the real one the holder has, else the placeholder it has."""
    # Rows without a holder get a key of their own, so that they do not gather anywhere.
    marked = rows.withColumn("object_type", F.coalesce(type_column, F.lit(""))).withColumn(
        "object_key", F.coalesce(key_column, F.concat(F.lit(SEPARATOR), "seq")))
    keys = marked.where(F.col("object_type") != "").select("object_type", "object_key").distinct()
    both = marked.unionByName(_held_in_state(state, keys, references, most), allowMissingColumns=True)
    seen = {"own_" + n: references[n] for n in names} | {"blank_" + n: references[n] for n in names if n in KEPT}
    both, attached = add_attached(both, since, seen)
    both, chunked = add_chunks(both, ["object_type", "object_key"], "seq", hot_rows)
    carried = carry_forward(both, ["object_type", "object_key"], ["seq"], list(attached.values()), chunked=chunked)
    held = {c: F.col("before_" + at) for c, at in attached.items()}
    real = [F.coalesce(F.col("own_" + n), held["own_" + n], *[held["blank_" + k] for k in KEPT if k == n]).alias("real_" + n)
            for n in names]
    return carried.where(F.col("seq") != "").select(*rows.columns, *real)


def resolve_parents(keyed: DataFrame, state: DataFrame, hot_rows: int | None = None,
                    since: DataFrame | None = None, shape: Shape = ALL) -> DataFrame | None:
    """(seq, new_<slot> ...) for the roots in which a parent's key differs from the observed one; None if no root of
    the shape can have such a parent."""
    held = tuple(n for n in HELD if n in shape.slots and (n != "site" or "prefix" in shape.slots))
    if not any(s in shape.slots for s in (*HOLDERS, "cluster", "platform")):
        return None
    rows = _narrow(keyed, shape)
    if "platform" in shape.slots:
        # One name may be on most devices; if the names are few, the devices are not shuffled by them.
        named, number, heavy = named_platforms(keyed, state), 0, None
        if hot_rows is not None:
            named = stage(named)
            number = named.count()
            heavy = None if number <= BROADCAST_KEYS else heavy_keys(rows, ["platform_name"], hot_rows)
            named = F.broadcast(named) if number <= BROADCAST_KEYS else named
        rows = join_salted(rows, named, ["platform_name"], heavy, "seq", most=number)
        rows = rows.withColumn("own_platform", F.coalesce("named_platform", "own_platform"))
    if any(s in shape.slots for s in HOLDERS):
        rows = _latest(rows, held, F.col("holder_type"), F.col("holder_key"), state, {h: h for h in held}, hot_rows, since, keyed.count())
    else:
        rows = rows.select("*", *[F.col("own_" + n).alias("real_" + n) for n in held])
    found = held
    if "cluster" in shape.slots:
        cluster = F.coalesce(F.col("own_cluster"),
                             F.when(F.col("want_cluster"), F.col("real_cluster")), F.col("cluster_key"))
        rows = rows.withColumn("cluster_key", F.when(F.col("cluster_key").isNotNull(), cluster))
        rows = _latest(rows, CLUSTER_HELD, F.when(F.col("cluster_key").isNotNull(), F.lit(CLUSTER)),
                       F.col("cluster_key"), state, {"cluster_group": "group", "cluster_type": "type"}, hot_rows, since,
                       keyed.count())
        found = (*held, *CLUSTER_HELD)
    new = {n: F.when(F.col("want_" + n), F.col("real_" + n)) for n in found}
    if "platform" in new:
        new["platform"] = F.coalesce(new["platform"], F.col("named_platform"))
    changed = rows.select("seq", *[c.alias("new_" + n) for n, c in new.items()])
    return changed.where(F.coalesce(*[F.col("new_" + n) for n in new], F.lit(None)).isNotNull())


def apply_resolution(keyed: DataFrame, resolved: DataFrame | None, shape: Shape = ALL) -> DataFrame:
    """Put the found parents in place: new keys, and ``kept_<slot>`` for parents only kept. ``keyed`` is staged."""
    kept = {s: F.lit(False) for s in shape.slots}
    if resolved is None:
        return keyed.withColumns({"kept_" + s: c for s, c in kept.items()})
    rows = keyed.join(shuffled(resolved, keyed.count()), "seq", "left")
    keys: dict[str, Column] = {s: F.col("key_" + s) for s in shape.slots}
    for slot in (*HELD, *CLUSTER_HELD):
        if "new_" + slot in resolved.columns:
            keys[slot] = F.coalesce(F.col("new_" + slot), F.col("key_" + slot))
    # What scopes a found object is the second part of its key.
    for slot, below in (("device_type", "manufacturer"), ("cluster", "cluster_site")):
        if slot in keys:
            keys[below] = F.when(_on(slot) & is_placeholder(slot),
                                 F.coalesce(key_part(keys[slot], 2), F.lit(UNDEFINED))).otherwise(keys[below])
    if "platform" in keys:
        maker = absent_if_empty(key_part(keys["platform"], 2))
        keep_maker = _on("platform") & ~_on("platform_manufacturer")
        keys["platform_manufacturer"] = F.when(keep_maker, maker).otherwise(keys["platform_manufacturer"])
        kept["platform"] = ~_on("platform") & keys["platform"].isNotNull()
        kept["platform_manufacturer"] = keep_maker & maker.isNotNull()
    if "cluster" in keys:
        kept["cluster"] = ~_on("cluster") & keys["cluster"].isNotNull()
    changed = set(keyed.columns) - {"key_" + s for s in shape.slots}
    return rows.select(*[c for c in keyed.columns if c in changed],
                       *[c.alias("key_" + s) for s, c in keys.items()],
                       *[c.alias("kept_" + s) for s, c in kept.items()])
